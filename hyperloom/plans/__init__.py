"""End-to-end plans: compression, differences, reports, and the registered queries (``plans.queries``)."""

from . import compress, report
from .compress import Compressed, compress_incremental, decompress, decompress_incremental, open_packets

__all__ = ["Compressed", "compress", "compress_incremental", "decompress", "decompress_incremental", "open_packets", "report"]
