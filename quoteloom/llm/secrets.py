"""Secret scans with a randomness test battery (native).

Two sources of spans, all found by JVM expressions over the whole text:

* *base* spans: keyword assignments, access keys and hex runs;
* *method* spans: other long runs of key characters that look random.  Each
  candidate's encoding is inferred from its characters, then the battery asks
  two things of it.

The first is whether it could be a uniform draw from that alphabet: chi-squared
uniformity, a runs test about the middle of the alphabet, and lag-one serial
correlation, combined by Bonferroni's rule.  A string that fails at ``ALPHA`` is
never a secret.  The second is whether it could be ordinary text, that is, a
word, name or slug with the letter frequencies of prose: its chi-squared sum
may be too small for that, or its runs of lower case, capitals, digits and marks
too many.  The smaller of these two p-values, doubled, is the candidate's
p-value.

What is flagged is controlled: by the Benjamini-Hochberg step-up rule within
strata of encoding and length, the expected share of ordinary strings among the
flagged stays under ``FDR`` in every length band.  So a short string, which can
hardly be told from a word, needs more evidence around it than a long one.  The
rule needs only the histogram of p-values per stratum, which has a fixed size
whatever the input (``STRATA * BINS`` counters).

Sequential work on the matches of a text (places, merging of spans) goes in
blocks of ``STEPS`` matches, so its cost is in proportion to their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

# The base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run that falls short at its first AKIA falls short at every later one
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: A candidate: a maximal run of 20 or more characters of base64 or of its URL form; where a run mixes their marks, its unmarked pieces of that length.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{20,}+(?![_-])|[A-Za-z0-9_-]{20,}+(?![+/]))={0,2}"
    r"|(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"
)
MARK = "\u0001"  # stands around matches for a moment; in a text it counts as \u0002, which is no key character either
STEPS = 256
CHUNK = 4096

# The alphabets, from the narrowest on.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("UPPER36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
LENGTH_EDGES = (24, 32, 48, 64, 128)
FDR = 0.05
ALPHA = 0.001
BINS = 400  # bin k holds p-values in (10 ** (-(k + 1) / 20), 10 ** (-k / 20)]

# What ordinary strings are made of. Letters in per mille of English prose; kinds of characters in shares of a string, by alphabet.
LETTERS = {
    "a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24,
    "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1,
}
SHARES = {"lower": 0.84, "upper": 0.06, "digit": 0.06, "mark": 0.04}
#: How often the kind of character changes from one to the next in slugs, paths and names of short words.
CHANGES = 0.35


def _ordinary(letters: str) -> tuple[float, float]:
    """Sums of the squares and cubes of the characters' frequencies in ordinary strings of an alphabet."""
    kinds = {"lower": [c for c in letters if c.islower()], "upper": [c for c in letters if c.isupper()], "digit": [c for c in letters if c.isdigit()], "mark": [c for c in letters if not c.isalnum()]}
    shares = {k: SHARES[k] for k, found in kinds.items() if found}
    if set(shares) == {"upper", "digit"}:  # names in capitals
        shares["upper"] = SHARES["lower"]
    out = []
    for k, share in shares.items():
        weights = [LETTERS.get(c.lower(), 1) for c in kinds[k]]
        out += [share / sum(shares.values()) * w / sum(weights) for w in weights]
    return sum(x**2 for x in out), sum(x**3 for x in out)


def _scan(items: Column, state: Column, step, emit, kind: str) -> Column:
    """``emit(state, item)``, an array of ``kind``, of every item in order, put together, the state going on by ``step``."""
    none = F.array().cast(f"array<{kind}>")
    many = F.size(items)
    blocks = F.when(many > 0, F.sequence(F.lit(0), F.floor((many - 1) / STEPS).cast("int"))).otherwise(F.array().cast("array<int>"))

    def block(acc: Column, j: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), none.alias("out"))
        inner = F.aggregate(F.slice(items, j * STEPS + 1, F.lit(STEPS)), begin, lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], emit(a["state"], x)).alias("out")))
        return F.transform(F.array(inner), lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))[0]

    whole = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(blocks, whole, block, lambda acc: acc["out"]))


def _parts(text: Column, pattern: str) -> Column:
    """The text cut about all leftmost non-overlapping matches: gap, match, gap, ..., gap; one pass over the text."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _spans(parts: Column, kind: int, pattern: str | None = None, least: int = 0) -> Column:
    """``array<struct<start, stop, kind, word>>``, in code points, of the matches in ``parts`` whose second group has ``least`` characters."""
    shape = "struct<start:int,stop:int,kind:int,word:string>"
    none = F.array().cast(f"array<{shape}>")

    def step(state: Column, x: Column) -> Column:
        return F.struct((state["at"] + F.length(x)).alias("at"), (~state["match"]).alias("match"))

    def emit(state: Column, x: Column) -> Column:
        taken = state["match"] & (F.length(F.regexp_extract(x, pattern, 2)) >= least) if least else state["match"]
        return F.when(taken, F.array(F.struct(state["at"].alias("start"), (state["at"] + F.length(x)).alias("stop"), F.lit(kind).alias("kind"), x.alias("word")))).otherwise(none)

    return F.when(F.size(parts) > 1, _scan(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("match")), step, emit, shape)).otherwise(none)


def _blanked(parts: Column, pattern: str | None = None, least: int = 0) -> Column:
    """The text with spaces for the matches that count."""

    def one(x: Column, i: Column) -> Column:
        taken = (i % 2 == 1) & (F.length(F.regexp_extract(x, pattern, 2)) >= least) if least else i % 2 == 1
        return F.when(taken, F.repeat(F.lit(" "), F.length(x))).otherwise(x)

    return F.array_join(F.transform(parts, one), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, good to about a tenth of itself however far out."""

    def tail(x: Column) -> Column:
        return (1 - F.exp(-1.4 * x)) * F.exp(-x * x / 2) / (1.135 * (2 * math.pi) ** 0.5 * x)

    return _let(z, lambda y: _let(_let(F.greatest(F.abs(y), F.lit(1e-6)), tail), lambda far: F.when(y >= 0, far).otherwise(1 - far)))


def _encoding(body: Column) -> Column:
    """Number of the narrowest alphabet that holds every character, or -1."""
    out = F.lit(-1)
    for i in reversed(range(len(ALPHABETS))):
        out = F.when(F.length(F.translate(body, ALPHABETS[i][1], "")) == 0, F.lit(i)).otherwise(out)
    return out


def _alphabet(code: Column) -> Column:
    """``struct<letters, halves, size, s2, s3>`` of an alphabet's number."""
    rows = []
    for _, letters in ALPHABETS:
        s2, s3 = _ordinary(letters)
        halves = "L" * (len(letters) // 2) + "H" * (len(letters) - len(letters) // 2)
        rows.append(F.struct(*(F.lit(x).alias(k) for k, x in (("letters", letters), ("halves", halves), ("size", float(len(letters))), ("s2", s2), ("s3", s3)))))
    return F.element_at(F.array(*rows), code + 1)


def _squares(body: Column) -> Column:
    """Sum of the squares of the characters' counts."""
    n = F.length(body)
    return F.aggregate(F.array_distinct(F.split(body, "")), F.lit(0.0), lambda acc, c: acc + F.pow((n - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)))


def random_p(body: Column, alphabet: Column, squares: Column) -> Column:
    """Bonferroni combination of the three tests of ``body`` against a uniform draw from the alphabet."""
    n = F.length(body).cast("double")
    letters, size = alphabet["letters"], alphabet["size"]
    # chi-squared uniformity; its tail by Wilson and Hilferty's cube root
    df = size - 1
    z1 = (F.cbrt(F.greatest(squares * size / n - n, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

    # runs about the middle of the alphabet
    def runs_z(half: Column) -> Column:
        high = F.length(F.replace(half, F.lit("L"), F.lit(""))).cast("double")
        runs = F.length(F.regexp_replace(half, "L+|H+", "x")).cast("double")

        def from_counts(product: Column) -> Column:
            var = F.greatest(product * (product - n) / (n * n * (n - 1)), F.lit(1e-9))
            return F.when(product > 0, F.abs(runs - product / n - 1) / F.sqrt(var)).otherwise(F.lit(9.0))

        return _let(2 * high * (n - high), from_counts)

    z2 = _let(F.call_function("translate", body, letters, alphabet["halves"]), runs_z)

    # lag-one serial correlation of the places in the alphabet
    def serial_z(centred: Column) -> Column:
        power = F.aggregate(centred, F.lit(0.0), lambda acc, x: acc + x * x)
        near = F.zip_with(F.slice(centred, 1, (n - 1).cast("int")), F.slice(centred, 2, (n - 1).cast("int")), lambda x, y: x * y)
        lagged = F.aggregate(near, F.lit(0.0), lambda acc, x: acc + x)
        return _let(power, lambda q: F.when(q > 0, F.abs(lagged / q + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0)))

    def centre(places: Column) -> Column:
        return _let(F.aggregate(places, F.lit(0.0), lambda acc, x: acc + x) / n, lambda mean: F.transform(places, lambda x: x - mean))

    places = F.transform(F.split(body, ""), lambda c: F.instr(letters, c).cast("double"))
    z3 = _let(_let(places, centre), serial_z)
    return F.least(3 * F.least(_normal_tail(z1), 2 * _normal_tail(z2), 2 * _normal_tail(z3)), F.lit(1.0))


def ordinary_p(body: Column, alphabet: Column, squares: Column) -> Column:
    """How well ordinary text explains ``body``: too even characters or too many runs of their kinds speak against it (the smaller p-value, doubled)."""
    n = F.length(body).cast("double")
    s2, s3 = alphabet["s2"], alphabet["s3"]
    pairs = n * (n - 1)
    var = 2 * pairs * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
    even = _normal_tail((n + pairs * s2 - squares) / F.sqrt(F.greatest(var, F.lit(1e-9))))
    changes = F.length(F.regexp_replace(body, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x")).cast("double") - 1
    broken = _normal_tail((changes - 0.5 - CHANGES * (n - 1)) / F.sqrt(CHANGES * (1 - CHANGES) * (n - 1)))
    return F.least(2 * F.least(even, broken), F.lit(1.0))


def _judged(word: Column) -> Column:
    """Stratum (encoding and length band) and p-value bin of a candidate; the stratum is negative without an encoding."""

    def of_body(body: Column) -> Column:
        band = sum(((F.length(body) >= edge).cast("int") for edge in LENGTH_EDGES), F.lit(0))

        def battery(alphabet: Column) -> Column:
            return _let(_squares(body), lambda x: F.when(random_p(body, alphabet, x) >= ALPHA, ordinary_p(body, alphabet, x)).otherwise(F.lit(1.0)))

        def of_code(code: Column) -> Column:
            p = F.when(code < 0, F.lit(1.0)).otherwise(_let(_alphabet(F.greatest(code, F.lit(0))), battery))
            level = F.least(F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-20)))), F.lit(BINS - 1)).cast("int")
            return F.struct((code * (len(LENGTH_EDGES) + 1) + band).alias("stratum"), level.alias("level"))

        return _let(_encoding(body), of_code)

    return _let(F.regexp_replace(word, "=+$", ""), of_body)


def found_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, tested``: base spans and judged candidates of every row, from one pass over the texts.

    The result holds spans only, not the texts, and is cut in the checkpoint folder.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), MARK, "\u0002")
    cut_up = df.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", _parts(F.col("text"), ASSIGN).alias("p0"), _parts(F.col("text"), ACCESS).alias("p1"), _parts(F.col("text"), HEX).alias("p2"))
    base = F.concat(_spans(F.col("p0"), 0, ASSIGN, ASSIGN_LEAST), _spans(F.col("p1"), 1), _spans(F.col("p2"), 2))
    # candidates lie outside the base spans
    rest = _blanked(_parts(_blanked(_parts(_blanked(F.col("p0"), ASSIGN, ASSIGN_LEAST), ACCESS)), HEX))
    outside = F.when((F.size("p0") > 1) | (F.size("p1") > 1) | (F.size("p2") > 1), rest).otherwise(F.col("text"))
    picked = cut_up.select("id", F.transform(base, lambda x: F.struct(x["start"], x["stop"], x["kind"])).alias("base"), _parts(outside, CANDIDATE).alias("p3"))
    runs = picked.select("id", "base", _spans(F.col("p3"), 3).alias("runs"))
    return cut(runs.select("id", "base", F.transform("runs", lambda r: F.struct(r["start"], r["stop"], r["kind"], _judged(r["word"]).alias("test"))).alias("tested")))


def flag_levels(found: DataFrame, fdr: float = FDR) -> DataFrame:
    """``stratum, least``: candidates whose level is ``least`` or more are flagged; at most one row a stratum.

    Benjamini-Hochberg on the histogram: with ``m`` candidates and ``r`` of
    them at or under ``p``, all of these are flagged if ``p * m <= fdr * r``.
    """
    tests = found.select(F.explode("tested.test").alias("t")).select("t.stratum", "t.level")
    counts = tests.groupBy("stratum", "level").count()
    left, right = counts.alias("l"), counts.alias("r")
    both = left.join(right, (F.col("l.stratum") == F.col("r.stratum")) & (F.col("r.level") >= F.col("l.level")))
    reach = both.groupBy(F.col("l.stratum").alias("stratum"), F.col("l.level").alias("level")).agg(F.sum("r.count").alias("under"))
    size = counts.groupBy("stratum").agg(F.sum("count").alias("m"))
    upper = F.pow(F.lit(10.0), -F.col("level") / 20.0)
    return reach.join(size, "stratum").where(upper * F.col("m") <= fdr * F.col("under")).groupBy("stratum").agg(F.min("level").alias("least"))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``id, spans``: all spans of every row, sorted by start, then kind.

    A span is ``struct<start, stop, kind>`` in code points, end exclusive;
    kinds are numbered as in ``KINDS``.  Defined cases: a null text is empty
    and has no span; an empty table gives no rows; repeated rows and repeated
    or null ids are judged one by one; other columns are ignored.
    """
    found = found_spans(df, id_col, text_col)
    levels = flag_levels(found, fdr)
    table = cut(levels.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias("least")))  # one row, a fixed number of strata
    joined = found.join(F.broadcast(table), how="left")
    taken = F.filter("tested", lambda r: (r["test"]["stratum"] >= 0) & (r["test"]["level"] >= F.coalesce(F.try_element_at(F.col("least"), r["test"]["stratum"]), F.lit(BINS))))
    random = F.transform(taken, lambda r: F.struct(r["start"], r["stop"], r["kind"]))
    order = F.array_sort(F.concat("base", random), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["kind"] - y["kind"]))
    return joined.select("id", order.alias("spans"))


def digest(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["stop"])), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``df`` with every span replaced by ``mark``; overlapping spans are replaced as one.  Rows and columns stay.

    Whole rows go through the scan beside their spans, so each is redacted by
    its own ones, whatever its id is.
    """
    rows = df.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = secret_spans(rows, "row", "text", fdr)
    text = F.col("id")[text_col]
    redacted = F.when(F.size("spans") > 0, _let(_merged(F.col("spans")), lambda cuts: _replaced(text, cuts, mark))).otherwise(text)
    return found.select(*((redacted if c == text_col else F.col("id")[c]).alias(c) for c in df.columns))


def _merged(spans: Column) -> Column:
    """``array<struct<start, stop>>``: overlapping spans (sorted by start) as one."""
    shape = "struct<start:int,stop:int>"
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("stop")))
    items = F.concat(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))), last)

    def step(state: Column, x: Column) -> Column:
        inside = x["start"] < state["stop"]
        return F.struct(F.when(inside, state["start"]).otherwise(x["start"]).alias("start"), F.greatest(state["stop"], x["stop"]).alias("stop"))

    def emit(state: Column, x: Column) -> Column:
        return F.when((state["stop"] >= 0) & (x["start"] >= state["stop"]), F.array(state)).otherwise(F.array().cast(f"array<{shape}>"))

    return _scan(items, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop")), step, emit, shape)


def _replaced(text: Column, cuts: Column, mark: str) -> Column:
    """The text with ``mark`` for every cut, put together from chunks of ``CHUNK`` characters."""

    def chunk(piece: Column, i: Column) -> Column:
        low = i * CHUNK

        def put_together(here: Column) -> Column:
            def before(c: Column, k: Column) -> Column:
                begin = F.when(k == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(here, F.greatest(k, F.lit(1)))["stop"], F.lit(0)) - low)
                return F.concat(F.substring(piece, begin + 1, F.greatest(c["start"] - low - begin, F.lit(0))), F.when(c["start"] >= low, F.lit(mark)).otherwise(F.lit("")))

            tail = F.substring(piece, F.coalesce(F.try_element_at(here, F.lit(-1))["stop"] - low, F.lit(0)) + 1, F.length(piece))
            return F.concat(F.array_join(F.transform(here, before), ""), tail)

        return _let(F.filter(cuts, lambda c: (c["start"] < low + F.length(piece)) & (c["stop"] > low)), put_together)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), chunk), "")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = secret_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return out.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), count(3).alias("n_random"),
    )
