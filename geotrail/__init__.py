"""PySpark jobs for vehicle tracks, road graphs, map tiles and sensor logs."""
