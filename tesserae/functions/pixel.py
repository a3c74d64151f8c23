"""Pixel arithmetic and colour as Column expressions. No data is NULL; NaN and infinities count as no data."""

from __future__ import annotations

import json

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07  # smallest step of a 32-bit float at 1
MAX_DEPTH = 64

# Five colours of each ramp, at 0, 0.25, 0.5, 0.75 and 1.
RAMPS = {
    "viridis": [(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)],
    "plasma": [(13, 8, 135), (126, 3, 168), (204, 71, 120), (248, 149, 64), (240, 249, 33)],
    "inferno": [(0, 0, 4), (85, 16, 109), (187, 55, 84), (249, 142, 10), (252, 255, 164)],
    "turbo": [(48, 18, 59), (67, 63, 167), (40, 175, 229), (220, 225, 57), (122, 4, 3)],
}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def is_finite(x) -> Column:
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite(x) -> Column:
    """x where it is a number, else NULL."""
    x = col(x)
    return F.when(is_finite(x), x)


def _once(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it: nested rules stay linear in size."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _operand(x) -> Column:
    return finite(x).cast("double") if isinstance(x, str) else col(x).cast("double")


def _clean(x: Column) -> Column:
    return _once(x, lambda v: F.when(F.abs(v) < float("inf"), v))


def binary(op: str, left, right, strict: bool = True) -> Column:
    """add, sub, mul or div; NULL unless both are finite. A divisor near zero is an error, or NULL when not strict.

    Operands are column names, or expressions that are finite or NULL, as those of this module are.
    """
    a, b = _operand(left), _operand(right)
    if op != "div":
        return _clean({"add": a + b, "sub": a - b, "mul": a * b}[op])
    zero = F.raise_error(F.lit("division by zero")).cast("double") if strict else F.lit(None).cast("double")
    return _clean(_once(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when(s["a"].isNotNull() & (F.abs(s["b"]) < EPSILON), zero).otherwise(F.try_divide(s["a"], s["b"]))))


def unary(op: str, value) -> Column:
    """sqrt, log (natural) or abs of a finite value; NULL where that is no number."""
    if op == "sqrt":
        return _once(_operand(value), lambda v: F.when(v >= 0, F.sqrt(v)))
    if op == "log":
        return _once(_operand(value), lambda v: F.when(v > 0, F.log(v)))
    if op == "abs":
        return F.abs(_operand(value))
    raise ValueError(f"unknown function {op!r}")


def band_math(rule: dict, bands: dict, strict: bool = True, depth: int = 0, mosaics: dict | None = None) -> Column:
    """A render rule as one Column. bands: band key (service, band) or band number -> column; mosaics: key of a mosaic
    (rule_key) -> column with its result.

    rule: {"band": 1}, {"band": 1, "service": "s"}, {"literal": 2.5}, {"op": "add", "left": rule, "right": rule} or
    {"op": "sqrt", "value": rule}.
    """
    if depth > MAX_DEPTH:
        raise ValueError("the rule is nested too deeply")
    if "band" in rule:
        if int(rule["band"]) < 1:
            raise ValueError("bands are counted from 1")
        key = (rule["service"], rule["band"]) if "service" in rule else rule["band"]
        if key not in bands:
            raise ValueError(f"band {key} is not among the source's bands")
        return finite(bands[key]).cast("double")
    if "literal" in rule:
        x = float(rule["literal"])
        if x != x or abs(x) == float("inf"):
            raise ValueError("a literal must be finite")
        return F.lit(x)
    op = rule.get("op")
    if op in ("add", "sub", "mul", "div"):
        return binary(op, *[band_math(rule[side], bands, strict, depth + 1, mosaics) for side in ("left", "right")], strict)
    if op in ("sqrt", "log", "abs"):
        return unary(op, band_math(rule["value"], bands, strict, depth + 1, mosaics))
    if op == "mosaic" and rule_key(rule) in (mosaics or {}):
        return finite(mosaics[rule_key(rule)]).cast("double")
    if op in ("colormap", "mosaic"):
        raise ValueError(f"{op} is only allowed as the outermost step")
    raise ValueError(f"unknown operation {op!r}")


def rule_key(rule: dict) -> str:
    """The same text for equal rules."""
    return json.dumps(rule, sort_keys=True)


def mosaics_of(rule: dict, depth: int = 0) -> list[dict]:
    """The distinct mosaics of a rule, those inside others before them."""
    if depth > MAX_DEPTH:
        raise ValueError("the rule is nested too deeply")
    out: dict[str, dict] = {}
    for part in ("left", "right", "value"):
        if isinstance(rule.get(part), dict):
            out |= {rule_key(m): m for m in mosaics_of(rule[part], depth + 1)}
    if rule.get("op") == "mosaic":
        out[rule_key(rule)] = rule
    return list(out.values())


def has_bare_band(rule: dict) -> bool:
    """A band is read outside of every mosaic."""
    return "band" in rule or rule.get("op") != "mosaic" and any(has_bare_band(rule[p]) for p in ("left", "right", "value") if isinstance(rule.get(p), dict))


def band_refs(rule: dict) -> list:
    """The distinct bands that a rule reads, in order."""
    if "band" in rule:
        return [(rule["service"], rule["band"]) if "service" in rule else rule["band"]]
    out: list = []
    for part in ("left", "right", "value", "source"):
        if isinstance(rule.get(part), dict):
            out += [b for b in band_refs(rule[part]) if b not in out]
    return out


def ndvi(red, nir, on_zero: str = "null") -> Column:
    """(nir - red) / (nir + red); a zero sum gives NULL, 0 or an error."""
    r, n = finite(red).cast("double"), finite(nir).cast("double")
    total = n + r
    zero = F.abs(total) < EPSILON
    other = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0), "error": F.raise_error(F.lit("division by zero")).cast("double")}[on_zero]
    return F.when(total.isNull(), None).when(zero, other).otherwise(F.try_divide(n - r, total))


def scale(value, factor: float = 1.0) -> Column:
    if factor < 0:
        raise ValueError("the factor must be 0 or more")
    return finite(value).cast("double") * F.lit(float(factor))


def normalise(value, by: list[str]) -> Column:
    """Min-max normalised within a tile and channel; 0 where all finite values are equal."""
    w = Window.partitionBy(*by)
    v = finite(value).cast("double")
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(v.isNotNull(), F.when(high - low < EPSILON, F.lit(0.0)).otherwise(F.try_divide(v - low, high - low)))


def _unit(t) -> Column:
    return F.least(F.greatest(finite(t).cast("double"), F.lit(0.0)), F.lit(1.0))


def _rgba(r, g, b, a) -> Column:
    return F.struct(*[x.cast("int").alias(n) for n, x in zip("rgba", (r, g, b, a), strict=True)])


def _shown(t, colour: Column) -> Column:
    clear = _rgba(*[F.lit(0)] * 4)
    return F.when(is_finite(t), colour).otherwise(clear)


def grayscale(t) -> Column:
    v = F.round(_unit(t) * 255)
    return _shown(col(t), _rgba(v, v, v, F.lit(255)))


def pseudocolor(t, ramp: str = "viridis") -> Column:
    stops, u = RAMPS[ramp], _unit(t)
    out = []
    for k in range(3):
        c = None
        for i in range(4):
            part = F.round(F.lit(float(stops[i][k])) + F.lit(float(stops[i + 1][k] - stops[i][k])) * (u - 0.25 * i) / 0.25)
            c = F.when(u <= 0.25 * (i + 1), part) if c is None else c.when(u <= 0.25 * (i + 1), part)
        out.append(c)
    return _shown(col(t), _rgba(*out, F.lit(255)))


def full_lut(entries: list) -> list:
    """At least two RGBA entries stretched to 256 by nearest index."""
    if len(entries) < 2:
        raise ValueError("a table needs two entries or more")
    last = len(entries) - 1
    return [tuple(entries[int(i * last / 255 + 0.5)]) for i in range(256)]


def lut(t, entries: list) -> Column:
    table = F.array(*[F.struct(*[F.lit(int(x)).alias(n) for n, x in zip("rgba", e, strict=True)]) for e in full_lut(entries)])
    return _shown(col(t), F.get(table, F.round(_unit(t) * 255).cast("int")))


def colormap_name(spec) -> Column:
    """grayscale, lut or a ramp, from an id or a JSON specification; unknown ones are grayscale, pseudocolor is viridis."""
    spec = col(spec)
    named = F.lower(F.trim(spec))
    parsed = F.from_json(spec, "colormap string, ramp string, entries array<array<int>>", {"mode": "PERMISSIVE"})
    ramp = F.coalesce(parsed["ramp"], F.lit("viridis"))
    return (
        F.when(named.isin(*RAMPS), named).when(named == "pseudocolor", "viridis")
        .when(parsed["colormap"] == "pseudocolor", F.when(ramp.isin(*RAMPS), ramp).otherwise("grayscale"))
        .when((parsed["colormap"] == "lut") & (F.size(parsed["entries"]) >= 2), "lut").otherwise("grayscale")
    )


def colormap(t, name: str | None, entries: list | None = None) -> Column:
    if name == "lut" and entries:
        return lut(t, entries)
    return pseudocolor(t, "viridis" if name == "pseudocolor" else name) if name in (*RAMPS, "pseudocolor") else grayscale(t)


def colormap_of(t, name) -> Column:
    """The colour by a column of colormap names."""
    out = None
    for ramp in RAMPS:
        out = F.when(col(name) == ramp, pseudocolor(t, ramp)) if out is None else out.when(col(name) == ramp, pseudocolor(t, ramp))
    return out.otherwise(grayscale(t))


def rgb(channels: dict, by: list[str]) -> Column:
    """Composite of up to three channels, each normalised within its tile. An absent channel counts as a finite 0."""
    out, seen = [], F.lit(False)
    for name in ("r", "g", "b"):
        c = channels.get(name)
        if c is None:
            out.append(F.lit(0))
            seen = F.lit(True)
        else:
            out.append(F.coalesce(F.round(normalise(c, by) * 255), F.lit(0)))
            seen = seen | is_finite(c)
    return F.struct(*[x.cast("int").alias(n) for n, x in zip("rgba", (*out, F.when(seen, 255).otherwise(0)), strict=True)])


def first_valid(value, order) -> Column:
    return F.min_by(finite(value), F.when(is_finite(value), col(order)))


#: Reducers of pixels that lie above each other.
REDUCERS = {
    "mean": lambda v: F.avg(finite(v).cast("double")), "max": lambda v: F.max(finite(v)), "min": lambda v: F.min(finite(v)), "sum": lambda v: F.sum(finite(v).cast("double")),
}
