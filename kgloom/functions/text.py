"""Scalar functions over URIs, labels, instructions and token texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of label normalisation. Another list is a parameter, see stopwords().
STOPWORDS = (
    "a about after afterwards again all almost alone along already also although always am among amongst amoungst an and another any anyhow anyone anything "
    "anyway anywhere are as at be became because become becomes becoming been before beforehand being but by can cannot cant co con could couldnt cry de "
    "describe do done during each eg either else elsewhere empty enough etc even ever every everyone everything everywhere except few fify fill find fire "
    "for found further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however i ie if "
    "in inc indeed into is it its itself keep latterly less ltd made may me meanwhile might mill mine more moreover most mostly move much must my myself "
    "namely neither never nevertheless next no nobody none noone nor not nothing now nowhere of off often on once only onto or otherwise our ours ourselves "
    "out own per perhaps please put rather re same see seem seemed seeming seems serious several she should since sincere so some somehow someone something "
    "sometime sometimes somewhere still such take than that the their them themselves then thence there thereafter thereby therefore therein thereupon "
    "these they this those though through throughout thru thus to together too toward towards un until up upon us very was we well were what whatever when "
    "whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with "
    "within without would yet you your yours yourself yourselves"
).split()


def stopwords(path: str) -> list[str]:
    """A stop-word list from a text file, separated by white space, for the ``stopwords`` parameter."""
    with open(path, encoding="utf-8") as f:
        return f.read().split()


def fragment(uri: Column) -> Column:
    """After the last '#', else after the last '/', else the whole."""
    hash_ = F.substring_index(uri, "#", -1)
    return F.when(F.instr(uri, "#") > 0, hash_).otherwise(F.substring_index(uri, "/", -1))


def mostly_numbers(text: Column) -> Column:
    """At least half of the characters that are not white space are digits; so is an empty text."""
    digits = F.length(F.regexp_replace(text, r"(?U)[^\p{Nd}]", ""))
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return digits >= solid / 2


def percent_decode(text: Column) -> Column:
    """URL unquoting that leaves malformed escapes and plus signs alone; bytes that are no UTF-8 become
    replacement characters. The text is put together in hexadecimal, so that escapes in a row make one
    character, all on the JVM and for texts with a percent sign alone."""
    escape = lambda p: p.rlike("^[0-9A-Fa-f]{2}")
    rest = lambda p: F.when(escape(p), F.concat(F.substring(p, 1, 2), F.hex(F.substring(p, F.lit(3), F.length(p))))).otherwise(F.concat(F.lit("25"), F.hex(p)))
    digits = F.array_join(F.transform(F.split(text, "%"), lambda p, i: F.when(i == 0, F.hex(p)).otherwise(rest(p))), "")
    return F.when(F.contains(text, F.lit("%")), F.make_valid_utf8(F.unhex(digits).cast("string"))).otherwise(text)


def token_set(label: Column, decode: bool = True, stopwords: tuple | list = STOPWORDS) -> Column:
    """A label's set of words, as a sorted array: the key of the lexical join.

    In order: trim, part camel case, underscores for spaces, lower case, percent-decoding, then
    an underscore for all but a-z, 0-9, white space, colon and underscore. As lower case precedes
    decoding, decoded capitals become underscores; as the apostrophe is gone by then, a genitive
    leaves an ``s``; white space other than the space stays inside words. All regular expressions
    are Unicode-aware. ``decode=False`` leaves the escapes as they are."""
    x = F.regexp_replace(label, r"(?U)^\s+|\s+$", "")
    x = F.regexp_replace(x, r'(?U)(?<!^)(?<!\s|")(?=[A-Z][a-z])', "_")
    x = F.lower(F.replace(x, F.lit(" "), F.lit("_")))
    x = percent_decode(x) if decode else x
    x = F.regexp_replace(x, r"(?U)[^a-z0-9\s:_]", "_")
    x = F.regexp_replace(x, r"_+", "_")
    words = F.array_except(F.split(x, "_"), F.array(*[F.lit(w) for w in ("", *stopwords)]))
    return F.array_sort(F.array_distinct(words))


def l2_normalized(v: Column) -> Column:
    """Unit vector as doubles; the zero vector stays zero."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sublist_positions(full: Column, sub: Column, first_only: bool = False, also: Column | None = None) -> Column:
    """Sorted distinct 0-based positions covered by occurrences of ``sub`` in ``full``, with those
    of the ids in ``also``. An empty ``sub`` occurs nowhere."""
    n, m = F.size(full), F.size(sub)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (m > 0) & (i + m <= n) & (F.slice(full, i + 1, F.greatest(m, F.lit(1))) == sub))
    if first_only:
        starts = F.slice(starts, 1, 1)
    covered = F.flatten(F.transform(starts, lambda i: F.sequence(i, i + m - 1)))
    if also is not None:
        special = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & F.array_contains(also, F.get(full, i)))
        covered = F.array_union(covered, special)
    return F.array_sort(F.array_distinct(covered))


# Patterns of a positive and a negative answer.
_TRUTH = {
    "general": (r"(?i)(^|[^\p{L}])(true|yes)([^\p{L}]|$)", r"(?i)(^|[^\p{L}])(false|no)([^\p{L}]|$)"),
    "specific": (r"(?iU)(^|[.,:\s])yes([.,:\s]|$)", r"(?iU)(^|[.,:\s])no([.,:\s]|$)"),
}


def is_positive(token: Column, kind: str = "general") -> Column:
    """general: true or yes, with no letter beside it; specific: yes between full stops, commas, colons or white space."""
    return F.rlike(token, F.lit(_TRUTH[kind][0]))


def is_negative(token: Column, kind: str = "general") -> Column:
    return F.rlike(token, F.lit(_TRUTH[kind][1]))


def _div(a: Column, b: int) -> Column:
    """The quotient rounded down, exact where a double is not."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def duration(ns: Column) -> Column:
    """HH:MM:SS of nanoseconds, a bigint or a decimal, in whole numbers throughout."""
    s = _div(ns, 1_000_000_000)
    return F.format_string("%02d:%02d:%02d", _div(s, 3600), _div(s % 3600, 60), s % 60)


# Relation signs and their names.
RELATION_SIGNS = {"=": "=", "≡": "=", ">": ">", "≥": ">", "⊒": ">", "<": "<", "≤": "<", "⊑": "<"}
RELATION_LABELS = {"=": "equivalence", "<": "subclass", ">": "superclass"}


def _lookup(x: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def normalized_relation(relation: Column) -> Column:
    """=, < or > for any of their spellings, otherwise null."""
    return _lookup(F.regexp_replace(relation, r"(?U)^\s+|\s+$", ""), RELATION_SIGNS)


def relation_label(sign: Column) -> Column:
    return _lookup(sign, RELATION_LABELS)
