import base64
import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken

from geotrail.llm import bpe, chat, media
from geotrail.llm.queries import PATTERN, RANKS

TEXTS = [None, "", " ", "a", "it's  two\n\n spaces 12 ?!", "é" * 900 + " x" * 700, "x" * 3000, "the cat sat. " * 400 + "\n\n  end", "日本語 🙂 text " * 300, " \n" * 2000]


def test_bpe_equals_tiktoken(spark):
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, TEXTS[7]])] + [(7, TEXTS[7], 2), (None, "null id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df, ranks, PATTERN, chunk=500, overlap=60), ranks, PATTERN).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    import numpy as np

    for r in got:
        want = own.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.bytes).decode() == (texts[r.doc_id] or "")
    assert bpe.encode(df.limit(0), ranks, PATTERN).count() == 0


@pytest.mark.parametrize("text", ["Слово за словом, и 12 слов. " * 60, "日本語の文章。漢字とかな、カタカナも。" * 90, "कुछ शब्द और । " * 120, "สวัสดีครับ คำไทย " * 100, "a,b;c-d" * 300, "it's 'll x'd\n\n " * 120])
def test_chunks_meet_in_every_script(text):
    """Every overlap has a boundary that both chunks see, and no piece begins inside a pre-token."""
    import regex

    starts = {m.start() for m in regex.finditer(PATTERN, text)}
    assert all(at in starts for at in range(1, len(text)) if bpe.sure(text, at))
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.load_ranks(public_tokenizers.path(RANKS)).splitlines())}, special_tokens={})
    cuts = [at for at in range(1, len(text)) if bpe.sure(text, at)]
    assert len(cuts) > len(text) // 40
    for at in cuts[:: max(1, len(cuts) // 40)]:
        assert own.encode_ordinary(text[:at]) + own.encode_ordinary(text[at:]) == own.encode_ordinary(text)


def test_unstitched_chunks_stay_together(spark):
    """A run that no overlap has a boundary in is encoded in one piece, what is around it is not."""
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    text = "one two three " * 200 + "x" * 2500 + " four five" * 300
    df = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, more int")
    (got,) = bpe.encode(df, ranks, PATTERN, keep=("more",), chunk=400, overlap=60).collect()
    import numpy as np

    assert np.frombuffer(bytes(got.ids), "<u4").tolist() == own.encode_ordinary(text) and got.more == 7


def brute_chat(turns):
    esc = lambda t: __import__("re").sub(r"([\[<])((?:/?(?:SYS|INST|TURN)|TEXT|SEP)\]|/?s>)", r"\1\\\2", t.replace("\\", "\\\\"))
    out, last, close = "", None, ""
    for role, text in turns:
        if role == last:
            out += "[SEP]" + esc(text)
            continue
        out += close
        opening, close = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}.get(role, (f"[TURN]{esc(role)}[TEXT]", "[/TURN]"))
        out, last = out + opening + esc(text), role
    return out + close


def test_chat_round_trip(spark):
    convs = {
        1: [("system", "be \\ good"), ("user", "[INST] <s>\\[/INST]"), ("user", "[\\INST]"), ("assistant", "</s>x"), ("assistant", ""), ("user", "bye")],
        2: [("tool", "[TEXT]a[SEP]"), ("", "no role"), ("assistant", "[SEP][/TURN]🙂")],
        3: [("assistant", "only")],
    }
    rows = [(c, k, r, t, 0) for c, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(4, 0, None, None, 0), (4, 0, None, None, 0)]
    convs[4] = [("", ""), ("", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segments int").repartition(3)
    chats = chat.format_chats(df).cache()
    told = {r.conv_id: r for r in chats.collect()}
    back = {r.conv_id: r for r in chat.digest(chats).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        assert told[c].formatted == brute_chat(turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert back[c].n_turns == len(turns) and back[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert back[c].loss_chars == len(loss) and back[c].loss_sha256 == sha(loss) and back[c].formatted_chars == len(told[c].formatted)
    for s in chat.loss_spans(chats).collect():
        assert told[s.conv_id].formatted[s.start : s.end] in [x.text for x in told[s.conv_id].segments if x.loss]
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 288, "z" * 576, "q" * 577, "long " * 60000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9, "a", "y")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.features(media.mux(df)).collect()}
    for i, t in [*enumerate(texts), (9, "a")]:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        file = media.mux_payload(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert got[2][1:] == got[9][1:]
    p = media.packets(media.mux(df)).filter("doc_id = 6").orderBy("k").collect()
    assert media.features(media.mux(df.limit(0))).collect() == [] and media.packets(media.mux(df.limit(0))).collect() == []
    assert len(p) == -(-300000 // 576) and [x.timestamp_ns for x in p] == [12_000_000 * k for k in range(len(p))] and p[0].codec == "A_PCM/INT/LIT"


def test_media_lacing_and_damage():
    E, u = media._element, media._uint
    sizes = [300, 10, 700, 5]
    body = b"".join(bytes([k]) * n for k, n in enumerate(sizes))
    xiph = bytes((0x81, 0, 0, 0x82, 3)) + bytes((255, 45, 10, 255, 255, 190)) + body
    signed = lambda d: ((d + 8191) | 0x4000).to_bytes(2, "big")
    ebml = bytes((0x81, 0, 5, 0x86, 3)) + (300 | 0x4000).to_bytes(2, "big") + signed(-290) + signed(690) + body
    cluster = media._element(media.CLUSTER, u(media.TIME, 7) + E(media.SIMPLE, xiph) + E(media.GROUP, E(media.BLOCK, ebml)))
    for file in (E(media.EBML, b"") + E(media.SEGMENT, cluster), b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + cluster[cluster.index(b"\xe7") :]):
        got = media.parse(file)
        assert got.complete and [p.size for p in got.packets] == sizes * 2
        assert all(file[p.offset : p.offset + p.size] == bytes([k % 4]) * p.size for k, p in enumerate(got.packets))
        assert [p.timestamp_ns for p in got.packets] == [7_000_000] * 4 + [12_000_000] * 4
    whole = media.mux_payload(b"a" * 576 * 20)
    for cut in (0, 3, 50, 300, len(whole) // 2):
        media.parse(whole[:cut])
    assert not media.parse(whole[: len(whole) // 2]).complete and not media.parse(b"not media at all").complete


def test_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from geotrail.llm.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    for t in ("documents", "conversations", "pages", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, d), duckdb.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want.project(", ".join(cols)).fetchall(), key=str), name
