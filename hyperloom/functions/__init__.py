"""Pure functions on bytes, and column expressions."""

from . import codec, entropy
from .codec import decode, decode_many, encode, encode_many, is_valid, pack, unpack

__all__ = ["codec", "decode", "decode_many", "encode", "encode_many", "entropy", "is_valid", "pack", "unpack"]
