"""Rounding and ratio columns. ``bround`` is half-even; ``half_up`` is the browser rule floor(x + 0.5)."""
from pyspark.sql import functions as F


def pct(ok, n, digits=0):
    r = F.bround(F.col(ok) / F.col(n) * 100, digits) if isinstance(ok, str) else F.bround(ok / n * 100, digits)
    return r.cast("bigint") if digits == 0 else r


def half_up(x):
    return F.floor(x + 0.5).cast("bigint")


def ratio_half_even(num, den, digits):
    """num / den of whole numbers (num >= 0, den > 0), rounded half to even; the remainder tells a tie, so nothing depends on floating point."""
    n, d = num.cast("bigint") * 10 ** digits, den.cast("bigint")
    q, r = (n - n % d) / d, n % d  # exact as doubles up to 2**53
    q = q.cast("bigint")
    up = (2 * r > d) | ((2 * r == d) & (q % 2 == 1))
    return (q + F.when(up, 1).otherwise(0)) / 10 ** digits


def half_even(x):
    return F.bround(x).cast("bigint")


def count_if(cond):
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def lookup(col, table, default=None):
    """Constant dictionary as a literal map; for tables of a few dozen entries."""
    if not table:
        return F.lit(default)
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hit = F.try_element_at(m, col)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def pack_map(key, value, sep=","):
    """Per group: 'k:v' entries in key order as one string. The key set per group must be small (modules, kinds)."""
    return F.array_join(F.array_sort(F.collect_list(F.concat(key, F.lit(":"), value.cast("string")))), sep)
