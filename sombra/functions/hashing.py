"""Keyed seeds (M3, M4): HMAC-SHA-256 built from ``sha2`` so it stays on the JVM.

HMAC(k, m) = H((k ^ opad) || H((k ^ ipad) || m)).  The two padded key blocks
are binary literals; ``sha2`` on binary gives a 64-digit hex string.  The
same construction runs in DuckDB (``sha256`` on blobs), which is what the
oracle queries use.

The key is a required argument.  Plans embed the padded blocks, so do not
log plans of masking jobs.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac
import os
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


@dataclass(frozen=True)
class MaskKey:
    """Secret for the keyed surrogates.  Never has a default."""

    secret: bytes = field(repr=False)

    def __post_init__(self):
        if not isinstance(self.secret, (bytes, bytearray)) or not self.secret:
            raise ValueError("MaskKey needs a non-empty bytes secret")

    @classmethod
    def from_env(cls, name: str = "SOMBRA_MASK_KEY") -> "MaskKey":
        value = os.environ.get(name)
        if not value:
            raise ValueError(f"environment variable {name} is not set")
        return cls(value.encode("utf-8"))

    def _block(self) -> bytes:
        k = self.secret
        if len(k) > BLOCK:
            k = hashlib.sha256(k).digest()
        return k.ljust(BLOCK, b"\0")

    @property
    def ipad_hex(self) -> str:
        return bytes(b ^ 0x36 for b in self._block()).hex()

    @property
    def opad_hex(self) -> str:
        return bytes(b ^ 0x5C for b in self._block()).hex()

    def hmac_hex(self, message: str) -> str:
        """Python reference value, for tests."""
        return _hmac.new(bytes(self.secret), message.encode("utf-8"), hashlib.sha256).hexdigest()


def hmac_hex(message: Column, key: MaskKey) -> Column:
    """64 hex digits of HMAC-SHA-256(key, utf8(message))."""
    inner = F.sha2(F.concat(F.unhex(F.lit(key.ipad_hex)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(key.opad_hex)), F.unhex(inner)), 256)


def hex_byte(h: Column, k) -> Column:
    """Byte ``k`` (0..31) of the digest as an int 0..255; ``k`` may be a Column."""
    pos = (F.lit(k) if not isinstance(k, Column) else k) * 2 + 1
    return F.conv(F.substr(h, pos, F.lit(2)), 16, 10).cast("int")


def hex_word(h: Column, k) -> Column:
    """Bytes ``k, k+1`` of the digest as an int 0..65535."""
    pos = (F.lit(k) if not isinstance(k, Column) else k) * 2 + 1
    return F.conv(F.substr(h, pos, F.lit(4)), 16, 10).cast("int")
