"""Hashes, seeds, rounding and arrays of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def digest(*parts: Column | str | int) -> Column:
    """SHA-256, in hex, of parts joined by U+0000."""
    return F.sha2(F.concat_ws(NUL, *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def stable_seed(*parts: Column | str | int) -> Column:
    """The first eight bytes of the digest, modulo 2**31."""
    return F.conv(F.substring(digest(*parts), 9, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2**31 - 1))


def round_exact(x: Column, places: int = 4) -> Column:
    """Rounds the exact binary value, half to even."""
    return F.regexp_replace(F.call_function("format_number", x, F.lit("0." + "0" * places)), ",", "").cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """v divided by its length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def masked_labels(prompt: Column, response: Column, end_id: int) -> Column:
    """-100 for each prompt id, then the response ids, with the end mark if they lack it."""
    ended = F.when(F.coalesce(F.try_element_at(response, F.lit(-1)) == end_id, F.lit(False)), response).otherwise(F.concat(response, F.array(F.lit(end_id))))
    return F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), ended)


def padded(ids: Column, width: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), width - F.size(ids)))


def learning_factor(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then a half cosine down to 0 at total; 1 if there is no total."""
    if total <= 0:
        return F.lit(1.0)
    falling = 0.5 * (1.0 + F.cos(F.lit(math.pi) * ((step - warmup) / F.lit(float(max(1, total - warmup))))))
    late = F.when(step >= total, 0.0).otherwise(falling)
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(late) if warmup > 0 else late


def steps_per_epoch(examples: int, accumulation: int, max_steps: int | None = None) -> int:
    return math.ceil((min(examples, max_steps * accumulation) if max_steps else examples) / accumulation)
