"""Colour arithmetic on structs r, g, b (0 to 255) and a (0 to 1), as plain expressions.

Perceptual work is done in OKLab; the matrices are that space's published constants.
"""

from __future__ import annotations

import colorsys
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RGBA = T.StructType([T.StructField(k, T.DoubleType()) for k in "rgba"])
# Named colours, the OKLab matrices (sRGB to cone response, cone response to Lab and back).
NAMED = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "gray": "#808080",
    "grey": "#808080", "silver": "#c0c0c0", "navy": "#000080", "teal": "#008080", "purple": "#800080", "orange": "#ffa500",
    "yellow": "#ffff00", "transparent": "#00000000",
}
TO_CONE = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
FROM_LAB = ((1, 0.3963377774, 0.2158037573), (1, -0.1055613458, -0.0638541728), (1, -0.0894841775, -1.291485548))
FROM_CONE = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
LUMA = (0.2126, 0.7152, 0.0722)
COLORS_IN_TEXT = r"(#[0-9a-fA-F]{8}(?![A-Za-z0-9_])|#[0-9a-fA-F]{6}(?![A-Za-z0-9_])|#[0-9a-fA-F]{3,4}(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?:rgba?|hsla?|oklch|oklab)\([^)]{3,80}\))"


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((r, g, b, a), "rgba", strict=True)])


def parse_hex(s: Column) -> Column:
    """#rgb, #rgba, #rrggbb, #rrggbbaa or a named colour; null for anything else."""
    names = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    part = lambda v, i: F.conv(F.substring(v, i, 2), 16, 10).cast("double")

    def of(v: Column) -> Column:
        alpha = F.when(F.length(v) == 9, part(v, 8) / 255).otherwise(F.lit(1.0))
        return F.when(v.rlike("^#(?:[0-9a-f]{6}|[0-9a-f]{8})$"), rgba(part(v, 2), part(v, 4), part(v, 6), alpha))

    named = let(F.lower(F.trim(s)), lambda t: F.coalesce(F.try_element_at(names, t), t))
    long = let(named, lambda t: F.when(t.rlike("^#[0-9a-f]{3,4}$"), F.regexp_replace(t, "([0-9a-f])", "$1$1")).otherwise(t))
    return let(long, of)


def _number(token: str, scale: float) -> float:
    t = token.strip().lower()
    if t == "none":
        return 0.0
    for suffix, factor in (("%", scale / 100), ("deg", 1.0), ("turn", 360.0), ("grad", 0.9), ("rad", 180 / math.pi)):
        if t.endswith(suffix):
            return float(t[: -len(suffix)]) * factor
    return float(t)


def _half_up(x: float) -> float:
    return float(math.floor(x + 0.5))


def _of_lab(lab: tuple[float, float, float], alpha: float) -> tuple[float, float, float, float]:
    cone = [sum(m * v for m, v in zip(row, lab, strict=True)) ** 3 for row in FROM_LAB]
    out = []
    for row in FROM_CONE:
        v = sum(m * c for m, c in zip(row, cone, strict=True))
        v = 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055
        out.append(_half_up(min(1.0, max(0.0, v)) * 255))
    return (*out, alpha)


def parse_one(text: str | None) -> tuple[float, float, float, float] | None:
    """The full grammar: hex, names, rgb(a), hsl(a), oklab, oklch, with commas or blanks, percents and angles."""
    s = NAMED.get((text or "").strip().lower(), (text or "").strip().lower())
    if re.fullmatch(r"#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", s):
        h = s[1:] if len(s) > 5 else "".join(c + c for c in s[1:])
        v = [int(h[i : i + 2], 16) for i in range(0, len(h), 2)]
        return (float(v[0]), float(v[1]), float(v[2]), v[3] / 255 if len(v) == 4 else 1.0)
    m = re.fullmatch(r"([a-z]+)\((.*)\)", s)
    if not m or m[1] not in ("rgb", "rgba", "hsl", "hsla", "oklab", "oklch"):
        return None
    main, _, slash = m[2].partition("/")
    parts = [p for p in re.split(r"[,\s]+" if "," not in main else ",", main.strip()) if p.strip()]
    parts += [slash] if slash.strip() else []
    if len(parts) < 3:
        return None
    try:
        alpha = min(1.0, max(0.0, _number(parts[3], 1))) if len(parts) > 3 else 1.0
        if m[1].startswith("rgb"):
            return (*[_half_up(min(255.0, max(0.0, _number(p, 255)))) for p in parts[:3]], alpha)
        if m[1].startswith("hsl"):
            hue, sat, light = _number(parts[0], 360) % 360, *(min(1.0, max(0.0, _number(p, 1))) for p in parts[1:3])
            return (*[_half_up(v * 255) for v in colorsys.hls_to_rgb(hue / 360, light, sat)], alpha)
        first, second, third = _number(parts[0], 1), _number(parts[1], 0.4), parts[2]
        if m[1] == "oklab":
            return _of_lab((first, second, _number(third, 0.4)), alpha)
        angle = math.radians(_number(third, 360))
        return _of_lab((first, second * math.cos(angle), second * math.sin(angle)), alpha)
    except ValueError:
        return None


@F.pandas_udf(RGBA)
def parse_color(s: pd.Series) -> pd.DataFrame:
    """The full grammar as a struct; all fields null where it cannot be read."""
    return pd.DataFrame([parse_one(x) or (None,) * 4 for x in s], columns=list("rgba"), dtype="float64")


def let(x: Column, f) -> Column:
    """f(x) with x computed once: an expression used several times over would otherwise be repeated in the plan."""
    return F.element_at(F.transform(F.array(x), f), 1)


def linear(c: Column) -> Column:
    return let(c / 255, lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))


def _rows(matrix: tuple, values: list[Column]) -> list[Column]:
    return [sum((F.lit(float(m)) * v for m, v in zip(row[1:], values[1:], strict=True)), F.lit(float(row[0])) * values[0]) for row in matrix]


def _triple(values: list[Column], names: tuple) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])


def oklab(c: Column) -> Column:
    """struct l, a, b of a colour."""
    names = ("l", "a", "b")
    fields = lambda x: [x[n] for n in names]
    light = let(c, lambda v: _triple([linear(v[k]) for k in "rgb"], names))
    cone = let(light, lambda v: _triple([F.cbrt(x) for x in _rows(TO_CONE, fields(v))], names))
    return let(cone, lambda v: _triple(_rows(TO_LAB, fields(v)), names))


def chroma(lab: Column) -> Column:
    return let(lab, lambda v: F.hypot(v["a"], v["b"]))


def hue(lab: Column) -> Column:
    """Degrees, 0 to 360."""
    return let(lab, lambda v: F.pmod(F.degrees(F.atan2(v["b"], v["a"])) + 360, F.lit(360.0)))


def hue_gap(h1: Column, h2: Column) -> Column:
    return F.abs(F.pmod(h1 - h2 + 540, F.lit(360.0)) - 180)


def distance(x: Column, y: Column) -> Column:
    """Euclidean OKLab distance times 100."""

    def of(v: Column) -> Column:
        d = [v["x"][k] - v["y"][k] for k in ("l", "a", "b")]
        return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * 100

    return let(F.struct(x.alias("x"), y.alias("y")), of)


def over(fg: Column, bg: Column) -> Column:
    """fg laid over bg, opaque."""
    both = F.struct(fg.alias("f"), bg.alias("g"))
    return let(both, lambda v: rgba(*[v["f"][k] * v["f"]["a"] + v["g"][k] * (1 - v["f"]["a"]) for k in "rgb"], F.lit(1.0)))


def luminance(c: Column) -> Column:
    return let(c, lambda v: _rows((LUMA,), [linear(v[k]) for k in "rgb"])[0])


def contrast(fg: Column, bg: Column) -> Column:
    """WCAG contrast; a translucent ground lies over white, a translucent text over the ground."""
    white = rgba(*[F.lit(255.0)] * 3, F.lit(1.0))
    ground = let(bg, lambda g: F.when(g["a"] < 1, over(g, white)).otherwise(g))
    text = lambda v: F.when(v["f"]["a"] < 1, over(v["f"], v["g"])).otherwise(v["f"])
    light = let(F.struct(fg.alias("f"), ground.alias("g")), lambda v: F.struct(luminance(text(v)).alias("t"), luminance(v["g"]).alias("g")))
    return let(light, lambda v: (F.greatest(v["t"], v["g"]) + 0.05) / (F.least(v["t"], v["g"]) + 0.05))


def to_hex(c: Column) -> Column:
    """#rrggbb, with the alpha's two digits below 1."""
    two = lambda v: F.lower(F.lpad(F.hex(F.floor(v + 0.5).cast("long")), 2, "0"))
    return let(c, lambda v: F.concat(F.lit("#"), two(v["r"]), two(v["g"]), two(v["b"]), F.when(v["a"] < 1, two(v["a"] * 255)).otherwise(F.lit(""))))


def colors_in_text(s: Column) -> Column:
    """Array of the colour notations in a text, in order."""
    return F.regexp_extract_all(s, F.lit(COLORS_IN_TEXT), F.lit(1))
