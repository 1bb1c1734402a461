"""Secret scans with Spark's own functions: fixed patterns and a randomness test battery.

Base spans are the leftmost non-overlapping matches of three patterns. The battery looks at long runs of token characters:
it infers a run's encoding from its characters and tests its symbols for uniformity (chi-squared), for runs above and below the
middle and for serial correlation. Within each class of length, as short runs have weak evidence, the battery's p-values are
held to a false-discovery rate: a run whose randomness they reject is no secret. Whether ordinary writing could look as even is
judged by the run's coincidences, under such a rate too. Nothing here is Python on the executors, and the work on a text grows
with its length and the number of its runs, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.llm.common import cut, let

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Stands for each code point of a base span when candidates are looked for; what is left of a run beside it is a run of its own.
FILL = "\uffff"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Elements that running sums append to one by one.
CHUNK = 256
#: Lower ends of the length classes; each has its own false-discovery control.
CLASSES = (20, 28, 40, 64)
#: Resolution of the histogram of p-values: bins per power of ten, and the last bin.
BINS, LAST_BIN = 10, 300
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


_SPANS = "array<struct<start:int,end:int,kind:string,token:string>>"


def running(values: Column) -> Column:
    """Running sums of an array of whole numbers, by chunks, as appending to an array copies it."""
    last = lambda v: F.coalesce(F.get(v, F.size(v) - 1), F.lit(0))
    none = F.expr("array()").cast("array<int>")
    grown = lambda state, x: F.array_append(state, last(state) + x)

    def chunked(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.aggregate(F.slice(v, k * CHUNK + 1, F.lit(CHUNK)), none, grown))

    def joined(chunks: Column) -> Column:
        before = F.aggregate(chunks, F.array(F.lit(0)), lambda state, c: grown(state, last(c)))
        return F.flatten(let(before, lambda lows: F.transform(chunks, lambda c, i: let(F.get(lows, i), lambda low: F.transform(c, lambda x: x + low)))))

    return F.when(F.size(values) > 0, let(let(values, chunked), joined)).otherwise(none)


def _parts(text: Column, pattern: str, grouped: bool) -> Column:
    """array<struct<piece, match, group>>: the pattern's matches with the piece of text before each and their first group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if grouped else found
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("piece"), found.alias("match"), group.alias("group"))
    return parts.cast("array<struct<piece:string,match:string,group:string>>")


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, end, kind, token>> of the pattern's matches; ``keep`` filters on the first group. Matches and the
    pieces between them alternate, so running sums of their lengths give the positions."""

    def placed(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: F.char_length(p["piece"]) + F.char_length(p["match"])))
        return F.zip_with(parts, ends, lambda p, end: F.struct((end - F.char_length(p["match"])).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), p["group"].alias("token")))

    spans = let(_parts(text, pattern, keep is not None), placed)
    return (F.filter(spans, lambda s: keep(s["token"])) if keep else spans).cast(_SPANS)


def _filled(text: Column, pattern: str, keep=None) -> Column:
    """The text with each code point of the pattern's matches (of which ``keep`` filters on the first group) as FILL."""
    over = lambda p: F.repeat(F.lit(FILL), F.char_length(p["match"]))
    piece = lambda p: F.concat(p["piece"], F.when(keep(p["group"]), over(p)).otherwise(p["match"]) if keep else over(p))
    rest = F.element_at(F.split(text, pattern, -1), -1)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.concat(F.array_join(F.transform(_parts(text, pattern, keep is not None), piece), ""), rest)).otherwise(text)


def candidates(text: Column) -> Column:
    """Spans of runs of 20 token characters or more outside base spans. Where a base span lies in a longer run, what is left of
    it on either side is a run of its own, if that long."""
    free = let(let(_filled(text, ASSIGN, lambda t: F.char_length(t) >= 12), lambda t: _filled(t, ACCESS)), lambda t: _filled(t, HEX))
    return F.when(F.regexp_like(text, F.lit(r"[A-Za-z0-9+/_=-]{20}")), let(free, lambda t: _spans(t, CANDIDATE, "random"))).otherwise(F.expr("array()").cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind as listed. Cheap tests come first: few texts need the parsing."""
    none = F.expr("array()").cast(_SPANS)
    lowered = F.lower(text)
    words = F.lit(False)
    for w in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        words = words | F.contains(lowered, F.lit(w))
    assign = F.when(words, _spans(text, ASSIGN, "assign", lambda t: F.char_length(t) >= 12)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access")).otherwise(none)
    hexes = F.when(F.regexp_like(text, F.lit(HEX)), _spans(text, HEX, "hex")).otherwise(none)
    both = F.concat(assign, access, hexes)
    order = F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("turn"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(order), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def alphabet(token: Column) -> Column:
    """Symbols of the inferred encoding, in order; null for runs that are no encoding of bytes (digits alone, one case of
    letters alone)."""
    like = lambda p: F.regexp_like(token, F.lit(p))
    return (
        F.when(like("^[0-9]+$") | like("^[a-z]+$") | like("^[A-Z]+$") | like("^[A-Z]?[a-z]+$"), F.lit(None).cast("string"))
        .when(like("^[0-9a-f]+$"), F.lit(_DIGITS + "abcdef")).when(like("^[0-9A-F]+$"), F.lit(_DIGITS + "ABCDEF"))
        .when(like("^[A-Z2-7]+$"), F.lit(_UPPER + "234567"))
        .when(like("^[0-9a-z]+$"), F.lit(_DIGITS + _LOWER)).when(like("^[0-9A-Z]+$"), F.lit(_DIGITS + _UPPER))
        .when(like("^[0-9A-Za-z]+$"), F.lit(_UPPER + _LOWER + _DIGITS))
        .when(like("^[0-9A-Za-z_-]+$"), F.lit(_UPPER + _LOWER + _DIGITS + "-_")).otherwise(F.lit(_UPPER + _LOWER + _DIGITS + "+/"))
    )


def normal_below(z: Column) -> Column:
    """Standard normal distribution function: the five-term polynomial in 1 / (1 + 0.2316419 |z|), error under 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-F.least(z * z, F.lit(1400.0)) / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, 1 - tail).otherwise(tail), F.lit(1e-300))


def battery(token: Column) -> Column:
    """struct<p_random, p_writing, length>: Bonferroni's p of the three tests against randomness, and the p of ordinary
    writing looking so even. Null where no encoding is inferred. Padding and symbols outside the alphabet are left out."""
    add = lambda a, x: a + x
    two = lambda z: 2 * normal_below(-F.abs(z))
    pairwise = lambda v, f: F.aggregate(F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), f), F.lit(0.0), add)

    def sums(x: Column) -> Column:
        v, size = x["v"], x["size"]
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(v), lambda c: F.size(F.filter(v, lambda y: y == c)).cast("double"))
        return F.struct(
            v.alias("v"), size.alias("size"), n.alias("n"), F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
            (F.aggregate(v, F.lit(0.0), add) / n).alias("middle"), F.aggregate(v, F.lit(0.0), lambda a, y: a + F.when(y >= size / 2, 1.0).otherwise(0.0)).alias("high"),
        )

    def shape(x: Column) -> Column:
        v, n, middle = x["v"], x["n"], x["middle"]
        half = x["size"] / 2
        return F.struct(
            n.alias("n"), x["size"].alias("size"), x["squares"].alias("squares"), (x["size"] / n * x["squares"] - n).alias("chi"),
            (pairwise(v, lambda a, b: F.when((a >= half) != (b >= half), 1.0).otherwise(0.0)) + 1).alias("turns"), (2 * x["high"] * (n - x["high"]) / n + 1).alias("expected"),
            pairwise(v, lambda a, b: (a - middle) * (b - middle)).alias("joint"), F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - middle) * (y - middle)).alias("spread"),
        )

    def scores(x: Column) -> Column:
        n, free, expected = x["n"], x["size"] - 1, x["expected"]
        # chi-squared by the cube root of Wilson and Hilferty; runs above and below the middle; correlation at lag one
        z_chi = (F.pow(F.greatest(x["chi"], F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        z_runs = F.coalesce(F.try_divide(x["turns"] - expected, F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.0)))), F.lit(40.0))
        z_serial = F.coalesce(F.try_divide(x["joint"], x["spread"]) * F.sqrt(n) + 1 / F.sqrt(n), F.lit(40.0))
        # coincidences: ordinary writing repeats its symbols more often than an even alphabet would
        usual = n * (n - 1) / 2 * F.greatest(F.lit(0.065), 1.8 / x["size"])
        z_writing = ((x["squares"] - n) / 2 + 0.5 - usual) / F.sqrt(1.5 * usual)
        return F.struct(n.alias("n"), z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"), z_writing.alias("writing"))

    def verdict(z: Column) -> Column:
        worst = F.least(normal_below(-z["chi"]), two(z["runs"]), two(z["serial"]))
        return F.struct(F.least(F.lit(1.0), 3 * worst).alias("p_random"), normal_below(z["writing"]).alias("p_writing"), z["n"].cast("int").alias("length"))

    def tested(letters: Column) -> Column:
        values = F.filter(F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, letters).cast("double") - 1), lambda v: v >= 0)
        start = F.struct(values.alias("v"), F.char_length(letters).cast("double").alias("size"))
        return let(start, lambda x: F.when(F.size(x["v"]) >= 16, let(let(let(sums(x), shape), scores), verdict)))

    return let(alphabet(token), lambda letters: F.when(letters.isNotNull(), tested(letters)))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text and, per row, ``base`` spans and ``runs`` (spans of candidate runs outside them, with their p-values)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("*", text.alias("__t"))
    rows = rows.select("*", base_spans(F.col("__t")).alias("base"), candidates(F.col("__t")).alias("__c"))
    tested = F.transform("__c", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), battery(c["token"]).alias("p")))
    return rows.select("*", F.filter(tested, lambda c: c["p"].isNotNull()).alias("runs")).drop("__c", "__t")


def _class(length: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(CLASSES):
        out = F.when(length >= low, i).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) * BINS), F.lit(LAST_BIN)).cast("int")


def discoveries(rows: DataFrame, p: str, rate: float) -> dict[int, int]:
    """Per length class, the lowest bin of the runs' p-values ``p`` that Benjamini and Hochberg's rule rejects. A histogram over all runs
    of the corpus, classes x bins rows, is all that reaches the driver; a bin counts with its largest p, so the rate holds."""
    each = rows.select(F.explode("runs.p").alias("p")).select(_class(F.col("p.length")).alias("k"), _bin(F.col(f"p.{p}")).alias("bin"))
    counts = each.groupBy("k", "bin").agg(F.count("*").alias("n"))
    total, upto = Window.partitionBy("k"), Window.partitionBy("k").orderBy(F.col("bin").desc())
    held = counts.select("k", "bin", F.sum("n").over(total).alias("m"), F.sum("n").over(upto).alias("r"))
    passed = held.where(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= rate * F.col("r") / F.col("m"))
    return {r["k"]: r["bin"] for r in passed.groupBy("k").agg(F.min("bin").alias("bin")).collect()}


def _limits(rows: DataFrame, rate: float, level: float) -> tuple[dict[int, int], dict[int, int]]:
    """Of the battery's p-values and of those of ordinary writing."""
    return discoveries(rows, "p_random", level), discoveries(rows, "p_writing", rate)


def _found(limits: tuple[dict[int, int], dict[int, int]]) -> Column:
    """Spans of the runs whose randomness the battery does not reject and that ordinary writing does not explain."""

    def rejected(c: Column, p: str, lows: dict[int, int]) -> Column:
        least = F.lit(LAST_BIN + 1)
        for k, low in lows.items():
            least = F.when(_class(c["p"]["length"]) == k, low).otherwise(least)
        return _bin(c["p"][p]) >= least

    good = lambda c: ~rejected(c, "p_random", limits[0]) & rejected(c, "p_writing", limits[1])
    return F.transform(F.filter("runs", good), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind")))


def _by_start(spans: Column) -> Column:
    turn = F.array(*map(F.lit, (*KINDS, "random")))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(turn, s["kind"]).alias("turn"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan(docs: DataFrame, rate: float = 0.01, level: float = 0.001) -> DataFrame:
    """doc_id, base, spans (arrays of start, end, kind; code points, end exclusive) of every row.

    ``rate``: false-discovery rate of writing rejected, ``level``: that of randomness rejected, within a length class.
    A null or empty text has no span. Repeated rows are scanned alike, other columns ignored, texts read whole.
    """
    rows = cut(scanned(docs.select("doc_id", "text")).drop("text"))
    return rows.select("doc_id", "base", _by_start(F.concat("base", _found(_limits(rows, rate, level)))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *map(count, KINDS), F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, rate: float = 0.01, level: float = 0.001, by: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping or adjoining ones together) replaced by ``by``, and n_chars, where there is such a
    column, counted again in changed rows. A span of any kind but assign takes the letters, digits, _ and - beside it along, so
    that no part of a longer secret stays. No row is dropped."""
    others = [c for c in docs.columns if c != "text"]
    rows = cut(scanned(docs.select("text", F.struct(F.lit(0).alias("__none"), *others).alias("__row"))))  # texts are scanned once
    rows = rows.withColumn("__spans", _by_start(F.concat("base", _found(_limits(rows, rate, level)))))
    ahead = lambda piece, cut_: F.when(cut_, F.regexp_replace(piece, r"^[A-Za-z0-9_-]++", "")).otherwise(piece)
    behind = lambda piece, cut_: F.when(cut_, F.regexp_replace(piece, r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++\z", "")).otherwise(piece)

    def step(state: Column, s: Column) -> Column:
        wide = s["kind"] != "assign"
        between = behind(ahead(F.substr(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), state["wide"]), wide)
        fresh, last = s["start"] >= state["at"], s["end"] > state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, let(between, lambda b: F.when((b == "") & (state["out"] != ""), state["out"]).otherwise(F.concat(state["out"], b, F.lit(by))))).otherwise(state["out"]).alias("out"), F.when(last, wide).otherwise(state["wide"]).alias("wide"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(False).alias("wide"))
    clean = F.aggregate("__spans", start, step, lambda s: F.concat(s["out"], ahead(F.substr(F.col("text"), s["at"] + 1), s["wide"])))
    new = F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))
    rows = rows.withColumn("__new", new)
    out = {"text": F.col("__new"), "n_chars": F.when(F.size("__spans") > 0, F.char_length("__new").cast("long")).otherwise(F.col("__row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[out[c].alias(c) if out.get(c) is not None else F.col("__row").getField(c).alias(c) for c in docs.columns])
