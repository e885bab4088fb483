"""Reading and writing graphs, triples, packets, images and sound."""

from . import graphs, media
from .graphs import read, read_json, read_kb, read_ntriples, read_packets, read_parquet, write_json, write_kb, write_packets, write_parquet

__all__ = ["graphs", "media", "read", "read_json", "read_kb", "read_ntriples", "read_packets", "read_parquet", "write_json", "write_kb", "write_packets", "write_parquet"]
