"""Text overlap in column expressions: BLEU-4 with the fourth smoothing of Chen and Cherry (2014), ROUGE-1 and ROUGE-L (Lin 2004) over Porter stems.

Definitions follow the publications; agreement with any one library's tokeniser to the last digit is not claimed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obliva.functions.logits import let

#: Words and single marks of BLEU; white space by its Unicode categories.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\x09-\x0D\x1C-\x1F\x85]"
#: Bits of a word of the common-subsequence vector: a sum of two words and a carry stays a positive long.
BITS = 62

#: The suffix tables of Porter (1980), steps 2 to 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# While a word is stemmed, a y that is a consonant is written Y: [aeiouy] are the vowels.
_SOME = "[aeiouy][^aeiouy]"
_MORE = "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]"
_CVC = "[^aeiouy][aeiouy][^aeiouywxY]$"
_DOUBLE = r"([^aeiouyY])\1$|yY$"


def _less(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _once(w: Column) -> Column:
    return w.rlike(_SOME) & ~w.rlike(_MORE)


# Each step looks at the last letters first: few words need its patterns.


def _ends(w: Column, *endings: str) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | F.endswith(w, F.lit(e))
    return out


def _marked(w: Column) -> Column:
    return F.when(F.contains(w, F.lit("y")), F.regexp_replace(F.regexp_replace(w, "(^|[aeiou])y", "$1Y"), "yy", "yY")).otherwise(w)


def _plural(w: Column) -> Column:
    return F.when(~_ends(w, "s") | _ends(w, "ss") & ~_ends(w, "sses"), w).when(_ends(w, "sses", "ies"), _less(w, 2)).otherwise(_less(w, 1))


def _past(w: Column) -> Column:
    def mended(x: Column) -> Column:
        double = x.rlike(_DOUBLE) & ~_ends(x, "l", "s", "z")
        return F.when(_ends(x, "at", "bl", "iz") | (~double & _once(x) & x.rlike(_CVC)), F.concat(x, F.lit("e"))).when(double, _less(x, 1)).otherwise(x)

    def cut(n: int) -> Column:
        return F.when(_less(w, n).rlike("[aeiouy]"), let(_less(w, n), mended)).otherwise(w)

    return F.when(_ends(w, "eed"), F.when(_less(w, 3).rlike(_SOME), _less(w, 1)).otherwise(w)).when(_ends(w, "ed"), cut(2)).when(_ends(w, "ing"), cut(3)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(_ends(w, "y", "Y") & _less(w, 1).rlike("[aeiouy]"), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)


def _cut_suffix(w: Column, suffixes, body) -> Column:
    """body of the base and the longest of the suffixes that the word ends in; the word itself if it has none of them."""
    ordered = sorted(suffixes, key=len, reverse=True)
    # A search from the left finds the longest first.
    found = F.regexp_extract(w, f"({'|'.join(ordered)})$", 1)
    of = lambda x: F.when(x == "", w).otherwise(body(F.substring(w, F.lit(1), F.length(w) - F.length(x)), x))
    return F.when(F.substring(w, -2, 2).isin(*sorted({x[-2:] for x in ordered})), let(found, of)).otherwise(w)


def _swapped(table: dict[str, str]):
    put = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return lambda w: _cut_suffix(w, table, lambda base, x: F.when(base.rlike(_SOME), F.concat(base, F.element_at(put, x))).otherwise(w))


def _dropped(w: Column) -> Column:
    return _cut_suffix(w, STEP4, lambda base, x: F.when(base.rlike(_MORE) & ((x != "ion") | _ends(base, "s", "t")), base).otherwise(w))


def _final_e(w: Column) -> Column:
    base = _less(w, 1)
    return F.when(_ends(w, "e") & (base.rlike(_MORE) | (_once(base) & ~base.rlike(_CVC))), base).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(_ends(w, "ll") & w.rlike(_MORE), _less(w, 1)).otherwise(w)


def stems(tokens: Column) -> Column:
    """Porter's stems of lower-case words; words of three letters at most stay as they are.  Each step runs once a word."""

    def of(t: Column) -> Column:
        out = t
        for step in (_marked, _plural, _past, _final_y, _swapped(STEP2), _swapped(STEP3), _dropped, _final_e, _final_l):
            out = F.transform(out, step)
        return F.zip_with(t, out, lambda w, s: F.when(F.length(w) <= 3, w).otherwise(F.translate(s, "Y", "y")))

    return let(tokens, of)


def numbered(items: Column) -> Column:
    """The items sorted, each with the number of its occurrence: a bag as a set, so that a common part can be found by hash."""

    def of(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def runs(r: Column) -> Column:
            return F.flatten(F.transform(r, lambda at, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(r, k + 1), n) - at), lambda j: F.concat(F.get(s, at), F.lit("\n"), j.cast("string")))))

        return let(starts, runs)

    return let(F.array_sort(items), of)


def clipped(a: Column, b: Column) -> Column:
    """How many items two arrays of strings have in common, each as often as the rarer side has it."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of tokens without white space, as strings."""

    def of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings, by bits (Hyyro 2004): a vector of longs for a, a step for each item of b."""
    full = (1 << BITS) - 1

    def places(x: Column, both: Column) -> Column:
        """The items that both have, by their number."""
        return F.filter(F.transform(x, lambda w: F.array_position(both, w).cast("int")), lambda i: i > 0)

    def bits(t: Column) -> Column:
        own, n = t["a"], F.size(t["a"])
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / BITS).cast("int"))

        def mask(symbol: Column) -> Column:
            one = lambda k: F.aggregate(F.transform(F.slice(own, k * BITS + 1, BITS), lambda x, i: F.when(x == symbol, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
            return F.transform(blocks, one)

        def fold(masks: Column) -> Column:
            def step(v: Column, item: Column) -> Column:
                def of(m: Column) -> Column:
                    def add(acc: Column, k: Column) -> Column:
                        def carried(s: Column) -> Column:
                            kept = s.bitwiseAND(F.lit(full)).bitwiseOR(F.get(v, k).bitwiseAND(F.bitwise_not(F.get(m, k))))
                            return F.struct(F.shiftright(s, BITS).alias("carry"), F.concat(acc["out"], F.array(kept)).alias("out"))

                        return let(F.get(v, k) + F.get(v, k).bitwiseAND(F.get(m, k)) + acc["carry"], carried)

                    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))
                    return F.aggregate(blocks, start, add)["out"]

                return let(F.get(masks, item - 1), of)

            ones = F.transform(blocks, lambda _: F.lit(full).cast("long"))
            left = F.aggregate(t["b"], ones, step)
            return F.size(blocks) * BITS - F.aggregate(F.transform(left, lambda x: F.bit_count(x)), F.lit(0), lambda s, x: s + x)

        symbols = F.sequence(F.lit(1), t["symbols"])
        return F.when(n > 0, let(F.transform(symbols, mask), fold)).otherwise(F.lit(0))

    def met(t: Column) -> Column:
        return let(F.array_intersect(t["a"], t["b"]), lambda both: let(F.struct(places(t["a"], both).alias("a"), places(t["b"], both).alias("b"), F.size(both).alias("symbols")), bits))

    return let(F.struct(a.alias("a"), b.alias("b")), met)


def _prf(hits: Column, n_out: Column, n_ref: Column) -> Column:
    """struct of precision, recall and fmeasure, to 4 places; 0 where there is nothing to divide by."""

    def of(x: Column) -> Column:
        share = lambda part, n: F.bround(F.when(n > 0, part.cast("double") / n).otherwise(F.lit(0.0)), 4)
        # 2PR / (P + R), as one division.
        return F.struct(share(x["hits"], x["out"]).alias("precision"), share(x["hits"], x["ref"]).alias("recall"), share(2 * x["hits"], x["out"] + x["ref"]).alias("fmeasure"))

    return let(F.struct(hits.alias("hits"), n_out.alias("out"), n_ref.alias("ref")), of)


def rouge1(reference: Column, output: Column) -> Column:
    return _prf(clipped(reference, output), F.size(output), F.size(reference))


def rouge_l(reference: Column, output: Column) -> Column:
    return _prf(common_subsequence(reference, output), F.size(output), F.size(reference))


def bleu4(reference: Column, output: Column) -> Column:
    """Sentence BLEU of orders 1 to 4 with equal weights; orders without a hit are smoothed by length."""

    def score(x: Column) -> Column:
        logs, missed = F.lit(0.0), F.lit(0)
        for k in range(4):
            hits = F.get(x["hits"], F.lit(k))
            most = F.greatest(F.lit(1), x["out"] - k).cast("double")
            missed = missed + F.when(hits == 0, 1).otherwise(0)
            smooth = 1 / (F.pow(F.lit(2.0), missed) * 5 / F.ln(x["out"].cast("double")))
            logs = logs + 0.25 * F.ln(F.when(hits == 0, smooth).otherwise(hits.cast("double")) / most)
        brevity = F.when(x["out"] > x["ref"], F.lit(1.0)).otherwise(F.exp(1 - x["ref"].cast("double") / x["out"]))
        nothing = (F.get(x["hits"], F.lit(0)) == 0) | ((x["out"] <= 1) & (F.array_min(x["hits"]) == 0))
        return F.when(nothing, F.lit(0.0)).otherwise(brevity * F.exp(logs))

    def of(t: Column) -> Column:
        hits = F.array(*[clipped(ngrams(t["o"], n), ngrams(t["r"], n)) for n in range(1, 5)])
        counts = F.struct(hits.alias("hits"), F.size(t["o"]).alias("out"), F.size(t["r"]).alias("ref"))
        return F.when(F.size(t["o"]) > 0, let(counts, score)).otherwise(F.lit(0.0))

    return let(F.struct(output.alias("o"), reference.alias("r")), of)


def text_metrics(output: Column, reference: Column, question: Column) -> Column:
    """struct of bleu, rouge1, rougeL and question_relevance, to 4 places; nulls count as empty."""
    lower = [F.lower(F.coalesce(x, F.lit(""))) for x in (output, reference, question)]
    pieces = [F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)) for x in lower[:2]]
    stemmed = [stems(F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))) for x in lower]

    def of(t: Column) -> Column:
        return F.struct(
            F.bround(bleu4(t["pr"], t["po"]), 4).alias("bleu"),
            rouge1(t["r"], t["o"]).alias("rouge1"),
            rouge_l(t["r"], t["o"]).alias("rougeL"),
            rouge_l(t["q"], t["o"])["fmeasure"].alias("question_relevance"),
        )

    return let(F.struct(*[x.alias(n) for x, n in zip([*pieces, *stemmed], ("po", "pr", "o", "r", "q"), strict=True)]), of)


def words(text: Column) -> Column:
    """Lower-case ASCII words, natively."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def unigram_overlap(a: Column, b: Column) -> Column:
    """Clipped count of shared words of two arrays."""
    return clipped(a, b)
