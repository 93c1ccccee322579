"""Secret scans with a randomness test battery, in DataFrame functions only.

Three patterns give base spans (assign, access, hex).  Besides, every long
token is tested.  Its encoding (hex, base32, base36, base62, base64) is inferred
from the symbols it uses, and three tests ask whether its symbols are drawn
evenly and independently from that alphabet: chi-squared uniformity, the runs of
upper and lower halves of the alphabet (Wald and Wolfowitz), and the serial
correlation of neighbouring symbols.  Fisher's method combines their p-values.

Under randomness the combined p-values are uniform, while words, paths and
counters pile up near 0.  So in each length class of the whole corpus the number
of random tokens is estimated from the upper half of the p-values (Storey), and
the least level is taken above which at most ``ALPHA`` of the tokens are other
than random: those are the "random" spans.

Spans count code points from 0, end exclusive, and are sorted by start, then
kind as listed.  Defined results: null or empty texts have no spans; null keys
and repeated rows are kept, a row each; texts of any length are scanned whole;
tokens of any length are tested whole, those of one symbol and padding are not
random; equal p-values are flagged together; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import cut

#: The base patterns, the group that must be long enough, and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
#: Long tokens, and the share of tokens other than random that a length class may have among those flagged.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHA = 0.05
#: Encodings: the tokens that may be of one (the first that fits counts), and its alphabet in order of the symbols' values.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Bins of the combined p-value, and length classes (powers of 2).
BINS, CLASSES = 1000, 16

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
#: Code points of a block of a text that is cut in many places.
BLOCK = 4096


def running(values: Column, first: Column, step) -> Column:
    """For each value what the ones before it add up to: step is associative and ``first`` its neutral element.

    The values go in blocks of about the root of their number, so that no list is copied more often than that.
    """

    def before(items: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        grown = F.aggregate(items, empty, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        return grown["out"]

    def cut_up(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda k: F.slice(v, k * w + 1, w)))

    def of(blocks: Column) -> Column:
        starts = before(F.transform(blocks, lambda x: F.aggregate(x, first, step)), first)
        return F.flatten(F.zip_with(blocks, starts, before))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(cut_up(v), of)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans (start, kind, end, text) of the leftmost matches that do not overlap, less those whose group is short."""
    kinds = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"

    def of(x: Column) -> Column:
        # A match by itself matches the same way, so its group is taken from it.
        parts = F.zip_with(x["whole"], F.slice(x["between"], F.lit(1), F.size(x["whole"])), lambda m, b: F.struct(m.alias("m"), F.char_length(m).cast("long").alias("n"), F.char_length(b).cast("long").alias("b")))

        def placed(p: Column) -> Column:
            at = running(F.transform(p, lambda y: y["n"] + y["b"]), F.lit(0).cast("long"), lambda a, y: a + y)
            spans = F.zip_with(p, at, lambda y, a: F.struct((a + y["b"]).alias("start"), F.lit(kind).alias("kind"), (a + y["b"] + y["n"]).alias("end"), y["m"].alias("text")))
            return F.filter(spans, lambda y: F.char_length(F.regexp_extract(y["text"], pattern, group) if group else y["text"]) >= least)

        return _let(parts, placed).cast(kinds)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(pattern), _let(found, of)).otherwise(F.array().cast(kinds))


def uncovered(base: Column, tokens: Column) -> Column:
    """The tokens (start, kind, end, text) that no base span covers: in order of starts, those that end beyond all base spans so far."""
    kind = len(BASE)

    def of(merged: Column) -> Column:
        ends = F.transform(merged, lambda x: F.when(x["kind"] < kind, x["end"]).otherwise(F.lit(-1).cast("long")))
        reach = running(ends, F.lit(-1).cast("long"), lambda a, x: F.greatest(a, x))
        met = F.zip_with(merged, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach")))
        return F.transform(F.filter(met, lambda y: (y["x"]["kind"] == kind) & (y["reach"] < y["x"]["end"])), lambda y: y["x"])

    # A base span comes before a token of the same start.
    return F.when((F.size(base) > 0) & (F.size(tokens) > 0), _let(F.array_sort(F.concat(base, tokens)), of)).otherwise(tokens)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _two_sided(z: Column) -> Column:
    """Chance that a normal deviate is as far from 0: the complementary error function by a rational approximation (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)

    def poly(t: Column) -> Column:
        return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))

    return F.least(F.lit(1.0), _let(1 / (1 + 0.3275911 * x), poly) * F.exp(-x * x))


def _upper(z: Column) -> Column:
    """Chance that a normal deviate is larger."""
    return _let(z, lambda v: F.when(v > 0, _two_sided(v) / 2).otherwise(1 - _two_sided(v) / 2))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def battery(token: Column) -> Column:
    """struct<encoding, chi, runs, serial, p>: the p-values of the three tests for randomness, and Fisher's combination of them.

    A token of fewer than two symbols (the rest is padding) has nothing to test: it is not random.
    """
    kind = F.coalesce(*[F.when(token.rlike(pattern), F.lit(k)) for k, (_, pattern, _) in enumerate(ENCODINGS[:-1])], F.lit(len(ENCODINGS) - 1))

    def bare(k: Column) -> Column:
        text = F.rtrim(token, F.lit("="))
        return F.struct(k.alias("kind"), F.when(k.isin(0, 2), F.lower(text)).when(k == 4, F.translate(text, "-_", "+/")).otherwise(text).alias("body"))

    def coded(x: Column) -> Column:
        alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), x["kind"] + 1)
        chars = F.filter(F.split(x["body"], "", -1), lambda c: c != "")
        count = F.length(x["body"]).cast("double")
        return F.struct(
            x["kind"].alias("kind"),
            F.length(alphabet).cast("double").alias("a"),
            count.alias("n"),
            F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(count - F.length(F.replace(x["body"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
            # = within a token is no symbol; it counts as the first one.
            F.transform(chars, lambda c: F.greatest(F.lit(0.0), F.call_function("instr", alphabet, c) - F.lit(1.0))).alias("codes"),
        )

    def paired(x: Column) -> Column:
        # The mean is a value of its own here: inside a lambda it would be added up for every symbol.
        after = F.slice(x["codes"], 2, 1 << 30)
        pairs = F.zip_with(after, x["codes"], lambda q, p: F.struct(q.alias("q"), p.alias("p")))
        return F.struct(*[x[c].alias(c) for c in ("kind", "a", "n", "squares", "codes")], F.filter(pairs, lambda y: y["q"].isNotNull()).alias("pairs"), (_sum(x["codes"]) / x["n"]).alias("mean"))

    def counted(x: Column) -> Column:
        half, mean = x["a"] / 2, x["mean"]
        return F.struct(
            *[x[c].alias(c) for c in ("kind", "a", "n", "squares")],
            _sum(F.transform(x["codes"], lambda c: F.when(c >= half, 1.0).otherwise(0.0))).alias("high"),
            (1 + _sum(F.transform(x["pairs"], lambda y: F.when((y["q"] >= half) != (y["p"] >= half), 1.0).otherwise(0.0)))).alias("runs"),
            _sum(F.transform(x["codes"], lambda c: (c - mean) * (c - mean))).alias("variance"),
            _sum(F.transform(x["pairs"], lambda y: (y["q"] - mean) * (y["p"] - mean))).alias("cross"),
        )

    def tested(x: Column) -> Column:
        n, a = x["n"], x["a"]
        # The statistic has mean a - 1 and variance 2 (a - 1) (n - 1) / n: a chi-squared of that shape, by Wilson and Hilferty's cube root.
        chi, scale = a / n * x["squares"] - n, (n - 1) / n
        freedom = (a - 1) / scale
        cube = F.pow(F.greatest(chi, F.lit(0.0)) / (scale * freedom), F.lit(1 / 3))
        uniform = _upper((cube - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom)))
        expected = 2 * x["high"] * (n - x["high"]) / n
        spread = expected * (expected - 1) / (n - 1)
        # With all symbols in one half there are no runs to count, and with one symbol no correlation: no evidence.
        runs = F.when(spread > 0, _two_sided((x["runs"] - 1 - expected) / F.sqrt(spread))).otherwise(F.lit(1.0))
        rho = x["cross"] / x["variance"]
        serial = F.when(x["variance"] > 0, _two_sided((rho + 1 / n) * F.sqrt(n))).otherwise(F.lit(1.0))
        return F.struct(x["kind"].alias("kind"), uniform.alias("chi"), runs.alias("runs"), serial.alias("serial"))

    def combined(t: Column) -> Column:
        # Fisher: -2 sum(ln p) is chi-squared with 6 degrees, whose tail is exp(-h) (1 + h + h^2 / 2) with h = -sum(ln p).
        h = -(F.ln(F.greatest(t["chi"], F.lit(1e-100))) + F.ln(F.greatest(t["runs"], F.lit(1e-100))) + F.ln(F.greatest(t["serial"], F.lit(1e-100))))
        name = F.element_at(F.array(*[F.lit(e[0]) for e in ENCODINGS]), t["kind"] + 1)
        return F.struct(name.alias("encoding"), t["chi"].alias("chi"), t["runs"].alias("runs"), t["serial"].alias("serial"), F.exp(-h) * (1 + h + h * h / 2)).alias("p")

    named = "struct<encoding:string,chi:double,runs:double,serial:double,p:double>"
    none = F.struct(F.lit(None).cast("string").alias("encoding"), *[F.lit(0.0).alias(c) for c in ("chi", "runs", "serial", "p")]).cast(named)
    full = _let(_let(_let(_let(_let(_let(kind, bare), coded), paired), counted), tested), combined).cast(named)
    return F.when(F.length(F.rtrim(token, F.lit("="))) > 1, full).otherwise(none)


def thresholds(counts: DataFrame) -> dict[int, int]:
    """The least bin that is flagged, by length class; counts: class, bin, n (CLASSES * BINS rows at most)."""
    by_class: dict[int, dict[int, int]] = {}
    for r in counts.collect():
        by_class.setdefault(r["class"], {})[r["bin"]] = r["n"]
    return {k: level(bins) for k, bins in by_class.items()}


def level(bins: dict[int, int]) -> int:
    """The least bin from 1 on from which at most ALPHA of the tokens are other than random, by the estimate of Storey."""
    total = sum(bins.values())
    # One more than were seen, as in the form for finite samples: a random token alone in its class counts.
    random = min(total, 2 * (1 + sum(n for b, n in bins.items() if b >= BINS // 2)))
    above = total - bins.get(0, 0)
    for b in range(1, BINS // 2 + 1):
        if above and above - random * (1 - b / BINS) <= ALPHA * above:
            return b
        above -= bins.get(b, 0)
    return BINS


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the key by default), base and spans of each document; kind 3 is the battery's."""
    t = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.struct(*(keep or [key])).alias("kept"), F.col(text).alias("text"))
    base = F.concat(*[matches(t, p, k, group, least) for k, (_, p, group, least) in enumerate(BASE)])
    # Tokens that a base span covers add nothing; the rest carry their test.
    tested = F.transform(
        uncovered(F.col("base"), matches(t, TOKEN, len(BASE))),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.least(F.lit(CLASSES - 1), F.floor(F.log2((s["end"] - s["start"]).cast("double"))).cast("int")).alias("class"),
            F.least(F.lit(BINS - 1), F.floor(battery(s["text"])["p"] * BINS)).cast("int").alias("bin"),
        ),
    )
    bare = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(_SPAN)
    found = cut(slim.withColumn("base", F.array_sort(base)).select("kept", bare.alias("base"), tested.alias("tested")))
    counts = found.select(F.explode("tested").alias("x")).groupBy("x.class", "x.bin").agg(F.count("*").alias("n"))
    least = thresholds(counts)
    levels = F.array(*[F.lit(least.get(k, BINS)) for k in range(CLASSES)])
    added = F.transform(F.filter("tested", lambda x: x["bin"] >= F.element_at(levels, x["class"] + 1)), lambda x: F.struct(x["start"], F.lit(len(BASE)).alias("kind"), x["end"]))
    return found.select("kept.*", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def count(spans: Column, kind: int) -> Column:
    """How many of the spans are of a kind.  The function has one parameter: a second one would be the place."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(n) for n, *_ in BASE], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that overlap count as one."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b, out of the blocks they lie in."""

        def of(x: Column) -> Column:
            first, last = F.get(blocks, x["i"]), F.get(blocks, x["j"])
            ends = F.concat(F.substr(first, x["a"] + 1), F.array_join(F.slice(blocks, x["i"] + 2, x["j"] - x["i"] - 1), ""), F.substr(last, F.lit(1), x["b"]))
            return F.when(x["i"] == x["j"], F.substr(first, x["a"] + 1, x["b"] - x["a"])).otherwise(ends)

        i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        places = F.struct(i.alias("i"), j.alias("j"), (a - i * BLOCK).cast("int").alias("a"), (b - j * BLOCK).cast("int").alias("b"))
        return F.when(a < b, _let(places, of)).otherwise(F.lit(""))

    def of(x: Column) -> Column:
        reach = running(F.transform(x["spans"], lambda s: s["end"]), F.lit(0).cast("long"), lambda a, e: F.greatest(a, e))
        # A span that begins where all before it have ended begins a mark; the text since then comes before it.
        opened = F.filter(F.zip_with(x["spans"], reach, lambda s, r: F.struct(s["start"].alias("start"), r.alias("reach"))), lambda y: y["start"] >= y["reach"])
        parts = F.transform(opened, lambda y: F.concat(piece(x["blocks"], y["reach"], y["start"]), F.lit(mark)))
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(x["blocks"], end, x["n"]))

    whole = F.struct(spans.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), F.char_length(text).cast("long").alias("n"))
    return F.when(F.size(spans) > 0, _let(whole, of)).otherwise(text)
