"""SQL text of the scalar functions.

Inputs are cast to double, NaN becomes null, and every result that is not finite becomes null; so
nothing overflows, divides by zero or differs between a missing value and NaN.
"""

from __future__ import annotations


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def num(name: str) -> str:
    """A numeric column as double with NaN as null."""
    return f"nanvl(cast({q(name)} as double), cast(null as double))"


def finite(sql: str) -> str:
    return f"if(isnan({sql}) or abs({sql}) = double('Infinity'), null, {sql})"


#: name -> (column suffix, SQL of {x})
TRANSFORMS: dict[str, tuple[str, str]] = {
    "log": ("log1p", "log1p(abs({x}))"),
    "log10": ("log10", "log10(abs({x}) + 1)"),
    "sqrt": ("sqrt", "sqrt(abs({x}))"),
    "square": ("sq", "({x} * {x})"),
    "cube": ("cb", "({x} * {x} * {x})"),
    "reciprocal": ("recip", "try_divide(1D, {x} + 1e-8D)"),
    "exp": ("exp", "if({x} is null, null, exp(least(greatest({x}, -50D), 50D)))"),
    "tanh": ("tanh", "tanh({x})"),
    "sin": ("sin", "sin({x})"),
    "cos": ("cos", "cos({x})"),
    "abs": ("abs", "abs({x})"),
    "sign": ("sign", "signum({x})"),
}


def transform(name: str, column: str) -> str:
    return finite(TRANSFORMS[name][1].format(x=num(column)))


def power(column: str, degree: int) -> str:
    return finite("(" + " * ".join([num(column)] * degree) + ")")


def product(a: str, b: str) -> str:
    return finite(f"({num(a)} * {num(b)})")


def ratio(a: str, b: str) -> str:
    return finite(f"try_divide({num(a)}, {num(b)} + 1e-8D)")


def difference(a: str, b: str) -> str:
    return finite(f"({num(a)} - {num(b)})")


def zscore(column: str, mean: float | None, std: float | None) -> str:
    """Standardised by statistics fixed when the plan was fitted."""
    if mean is None or std is None:
        return "cast(null as double)"
    return finite(f"(({num(column)} - {mean!r}D) / {std + 1e-8!r}D)")


def normalised_by(a: str, mean_a: float | None, c: str) -> str:
    if mean_a is None:
        return "cast(null as double)"
    return finite(f"try_divide({num(a)} - {mean_a!r}D, {num(c)} + 1e-8D)")


def text(name: str) -> str:
    return f"coalesce(cast({q(name)} as string), '')"


#: White space, as Unicode has it.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _words(s: str) -> str:
    """White-space separated words; compiled, so that Spark works them out once for all features of a row."""
    return f"array_remove(split(translate({s}, '{BLANKS}', '{' ' * len(BLANKS)}'), ' '), '')"


def text_features(name: str) -> dict[str, str]:
    """Statistics of one text column, by suffix."""
    s = text(name)
    w = _words(s)
    size = f"size({w})"
    return {
        "char_length": f"length({s})",
        "word_count": size,
        "uppercase_ratio": f"regexp_count({s}, '\\\\p{{Lu}}') / greatest(length({s}), 1)",
        "digit_ratio": f"regexp_count({s}, '\\\\p{{Nd}}') / greatest(length({s}), 1)",
        "space_ratio": f"regexp_count({s}, '(?U)[\\\\s\\\\x1c-\\\\x1f]') / greatest(length({s}), 1)",
        "special_char_count": f"regexp_count({s}, '(?U)[^\\\\p{{L}}\\\\p{{N}}\\\\s]')",
        "avg_word_length": f"length(array_join({w}, '')) / greatest({size}, 1)",
        "unique_word_ratio": f"size(array_distinct({_words(f'lower({s})')})) / greatest({size}, 1)",
    }


def pattern_features(name: str) -> dict[str, str]:
    """Pattern counts of one text column, by suffix."""
    s = text(name)
    w = _words(s)
    return {
        "sentence_count": f"regexp_count({s}, '[.!?]+')",
        "digit_count": f"regexp_count({s}, '\\\\p{{Nd}}')",
        "special_char_count": f"regexp_count({s}, '[^a-zA-Z0-9\\\\s]')",
        "exclamation_count": f"regexp_count({s}, '!')",
        "question_count": f"regexp_count({s}, '[?]')",
        "caps_word_ratio": f"size(filter({w}, x -> upper(x) = x and lower(x) <> x)) / greatest(size({w}), 1)",
    }
