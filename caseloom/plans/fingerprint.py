"""Order-aware fingerprints of event sequences.

The fingerprint of a sequence is the xor of hashes of its (position, name)
elements.  Xor combines before the shuffle and in any order, so a case of any
length gets its 128-bit fingerprint without building an array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element_hashes(*parts: Column | str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of one element."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit("second"), *reversed(cols))


def uniform(seed: int, salt: str, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends only on the keys, so retries agree: the
    first 52 bits of the md5 of seed, salt and keys, which other engines have too."""
    cols = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *cols).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def gaussian(seed: int, salt: str, *keys: Column | str) -> Column:
    """A standard normal number that depends only on the keys."""
    u = uniform(seed, salt + ":u", *keys)
    v = uniform(seed, salt + ":v", *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u)) * F.cos(F.lit(6.283185307179586) * v)
