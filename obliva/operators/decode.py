"""Constrained decoding over tables of logits.

Tokens are the 64 characters from the space on; a token's id is its code less 32.
A sequence has at most ten positions, so one row's decoding is a fold over an
array in its own row: no join and no shuffle for a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obliva.functions import logits as L
from obliva.functions.attributes import MAX_POSITIONS, complete

FIRST = 32


def _t(c: str) -> int:
    return ord(c) - FIRST


#: What a year's digit allows next: position, token before, allowed tokens.
YEAR_RULES = [
    (2, _t("1"), [_t("9")]),
    (2, _t("2"), [_t("0")]),
    (3, _t("9"), [_t(c) for c in "789"]),
    (3, _t("0"), [_t("0")]),
    (4, _t("7"), [_t(c) for c in "56789"]),
    (4, _t("0"), [_t(c) for c in "01234"]),
]


def token_ids(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)


def vocabulary_text(rows: DataFrame, ids: str, vocabulary: DataFrame, special: tuple[int, ...] = ()) -> DataFrame:
    """rows with ``text``: the ids spelt by a vocabulary (id, piece) of any size, special ids left out; an unknown id shows as <id>.

    The rows keep a number of their own only until their pieces are back together.  It is dealt once: a second reading
    could deal it otherwise.  The other columns go with the first id.
    """
    numbered = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "text"]).alias("_kept"), F.col(ids).alias("_ids")).withColumn("_row", F.monotonically_increasing_id())
    spelt = numbered.select("_row", "_kept", F.posexplode_outer("_ids").alias("_at", "id"))
    spelt = spelt.withColumn("_kept", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_kept")))
    spelt = spelt.join(vocabulary.select("id", "piece"), "id", "left")
    piece = F.coalesce("piece", F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">")))
    shown = F.col("_at").isNotNull() & ~F.coalesce(F.col("id").isin(*special), F.lit(False)) if special else F.col("_at").isNotNull()
    pieces = F.array_sort(F.collect_list(F.when(shown, F.struct("_at", piece.alias("p")))))
    texts = spelt.groupBy("_row").agg(F.first("_kept", ignorenulls=True).alias("_kept"), F.array_join(F.transform(pieces, lambda x: x["p"]), "").alias("text"))
    return texts.select("_kept.*", "text")


def decoded(ids: Column) -> Column:
    """Text of the ids; an id outside the vocabulary shows as <id>."""
    return F.array_join(F.transform(ids, lambda i: F.when((i >= 0) & (i < 64), F.char(i + FIRST)).otherwise(F.concat(F.lit("<"), i.cast("string"), F.lit(">")))), "")


def position_tokens(values: DataFrame) -> DataFrame:
    """attribute, pos, token: the tokens that ' value.' has at each position, up to the attribute's length."""
    longest = F.element_at(F.create_map(*[F.lit(x) for kv in MAX_POSITIONS.items() for x in kv]), F.col("attribute"))
    spelt = values.select("attribute", F.slice(token_ids(F.concat(F.lit(" "), F.trim("value"), F.lit("."))), F.lit(1), F.coalesce(longest, F.lit(20))).alias("t"))
    return spelt.select("attribute", F.posexplode("t").alias("pos", "token")).distinct()


def position_sets(tokens: DataFrame) -> DataFrame:
    """attribute and its sets: an array, by position, of sorted tokens."""
    by_pos = tokens.groupBy("attribute", "pos").agg(F.sort_array(F.collect_set("token")).alias("set"))
    return by_pos.groupBy("attribute").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "set"))), lambda x: x["set"]).alias("sets"))


def allowed(attribute: Column, pos: Column, before: Column, base: Column) -> Column:
    """The base set, narrowed by the rule for the token before; a rule that leaves nothing does not count."""
    out = base
    for p, token, tokens in YEAR_RULES:
        narrow = F.array_intersect(base, F.array(*map(F.lit, tokens)))
        out = F.when((attribute == "year_of_birth") & (pos == p) & (before == token), F.when(F.size(narrow) > 0, narrow).otherwise(base)).otherwise(out)
    return out


def _score(steps: Column, pos: Column, token: Column, flip: bool) -> Column:
    return F.get(F.get(steps, pos), token) * (-1.0 if flip else 1.0)


def flip_decode(rows: DataFrame, sets: DataFrame, flip: bool, truth: str | None = None) -> DataFrame:
    """rows (attribute, steps: logits by position) with ``tokens`` and ``text``: at each position the best allowed token, lower id on ties.

    With a column of true tokens also ``orders``: at each step the place of the true token among the allowed ones, by the
    logits as they are, and the last place ("-1" where it is not allowed).
    """

    def step(acc: Column, pos: Column) -> Column:
        before = F.get(acc, pos - 1)
        options = allowed(F.col("attribute"), pos, before, F.get(F.col("sets"), pos))
        scored = F.transform(options, lambda t: F.struct((-_score(F.col("steps"), pos, t, flip)).alias("s"), t.alias("t")))
        return F.concat(acc, F.array(F.array_min(scored)["t"]))

    span = F.sequence(F.lit(0), F.least(F.size("sets"), F.size("steps")) - 1)
    joined = rows.join(F.broadcast(sets), "attribute")  # one row for each attribute
    out = joined.withColumn("tokens", F.aggregate(span, F.array().cast("array<int>"), step))
    if truth is not None:

        def note(token: Column, pos: Column) -> Column:
            def of(options: Column) -> Column:
                rank = F.coalesce(rank_among(F.get("steps", pos), options, F.get(F.col(truth), pos)), F.lit(-1))
                return F.concat_ws("/", rank.cast("string"), (F.size(options) - 1).cast("string"))

            return L.let(allowed(F.col("attribute"), pos, F.get("tokens", pos - 1), F.get("sets", pos)), of)

        out = out.withColumn("orders", F.transform("tokens", note))
    return out.withColumn("text", decoded(F.col("tokens"))).drop("sets")


def beam_decode(rows: DataFrame, sets: DataFrame, flip: bool, k: int, c: int, entropy: bool = False) -> DataFrame:
    """rows with ``beams``: up to k (score, tokens, text), best first.

    A beam's score is the sum of its raw (or negated) logits, weighted by entropy if asked for; ties go to the smaller
    token sequence.  Beams whose value is complete are set aside and, if there are any, are the result.
    """
    beam = "array<struct<score:double,tokens:array<int>>>"

    def ordered(beams: Column) -> Column:
        keyed = F.transform(beams, lambda b: F.struct((-b["score"]).alias("s"), b["tokens"].alias("tokens")))
        return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda b: F.struct((-b["s"]).alias("score"), b["tokens"].alias("tokens")))

    def grown(pos: Column):
        def of(b: Column) -> Column:
            options = allowed(F.col("attribute"), pos, F.get(b["tokens"], pos - 1), F.get(F.col("sets"), pos))
            scored = F.transform(options, lambda t: F.struct((-_score(F.col("steps"), pos, t, flip)).alias("s"), t.alias("t")))

            def best(x: Column) -> Column:
                weight = L.entropy_weight(F.transform(x, lambda y: -y["s"])) if entropy else F.lit(1.0)
                longer = lambda w: F.transform(F.slice(F.array_sort(x), 1, c), lambda y: F.struct((b["score"] - w * y["s"]).alias("score"), F.concat(b["tokens"], F.array(y["t"])).alias("tokens")))
                return L.let(weight, longer)

            return L.let(scored, best)

        return of

    def done(b: Column) -> Column:
        return complete(decoded(b["tokens"]), F.col("attribute"))

    def step(acc: Column, pos: Column) -> Column:
        def parted(new: Column) -> Column:
            return F.struct(ordered(F.filter(new, lambda b: ~done(b))).alias("open"), ordered(F.concat(acc["done"], F.filter(new, done))).alias("done"))

        def kept(n: Column) -> Column:
            # When no beam is open any more, what was open before stays: it is the result if nothing was complete.
            still = F.when((F.size(n["open"]) > 0) | (F.size(n["done"]) > 0), n["open"]).otherwise(acc["open"])
            return F.struct(still.alias("open"), n["done"].alias("done"))

        return L.let(L.let(F.flatten(F.transform(acc["open"], grown(pos))), parted), kept)

    start = F.struct(F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("tokens"))).cast(beam).alias("open"), F.array().cast(beam).alias("done"))
    span = F.sequence(F.lit(0), F.least(F.size("sets"), F.size("steps")) - 1)
    best = F.aggregate(span, start, step, lambda acc: F.when(F.size(acc["done"]) > 0, acc["done"]).otherwise(acc["open"]))
    joined = rows.join(F.broadcast(sets), "attribute")  # one row for each attribute
    return joined.withColumn("beams", F.transform(best, lambda b: F.struct(b["score"].alias("score"), b["tokens"].alias("tokens"), decoded(b["tokens"]).alias("text")))).drop("sets")


def with_candidates(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows (attribute, pos, ...) with ``options``, the candidate tokens of the position; digits where a position has no set."""
    digits = F.array(*[F.lit(_t(c)) for c in "0123456789"])
    sets = tokens.groupBy("attribute", "pos").agg(F.sort_array(F.collect_set("token")).alias("_set"))
    return rows.join(F.broadcast(sets), ["attribute", "pos"], "left").withColumn("options", F.coalesce("_set", digits)).drop("_set")  # a few dozen rows


def rank_among(logits: Column, options: Column, token: Column) -> Column:
    """Place of a token among the options by logit, from 0, lower id first on ties; null if it is not among them."""

    def before(t: Column) -> Column:
        own, other = F.get(logits, token), F.get(logits, t)
        return (other > own) | ((other == own) & (t < token))

    return F.when(F.array_contains(options, token), F.size(F.filter(options, before)))


def token_rank(rows: DataFrame) -> DataFrame:
    """rows (logits, options, truth) with rank (from 0; -1 if absent), max_rank and note of the true token, all within the row."""
    rank = F.coalesce(rank_among(F.col("logits"), F.col("options"), F.col("truth")), F.lit(-1))
    out = rows.withColumns({"rank": rank, "max_rank": F.size("options") - 1}).drop("logits", "options")
    return out.withColumn("note", F.concat_ws("/", F.col("rank").cast("string"), F.col("max_rank").cast("string")))


def gradient_order(rows: DataFrame, largest: bool, npo_beta: float | None = None) -> DataFrame:
    """rows (logits, options, hidden_norm, reference for NPO) with ``ordered``: the options (key, token, norm) in the order of the
    norm of the last layer's gradient.  Each softmax is computed once for a row, to the last bit as in C: sums of the same norms
    in another order are equal but for it."""
    rows = rows.withColumns({"_p": L.softmax_c(F.col("logits"))} | ({"_q": L.softmax_c(F.col("reference"))} if npo_beta is not None else {}))
    softs = F.struct(F.col("_p").alias("p"), (F.col("_q") if npo_beta is not None else F.lit(None)).alias("q"), F.col("hidden_norm").alias("h"))

    def of(x: Column) -> Column:
        return L.let(L.total(F.transform(x["p"], lambda y: y * y)), lambda square: F.transform(F.col("options"), lambda t: one(x, square, t)))

    def one(x: Column, square: Column, t: Column) -> Column:
        norm = L.gradient_norm(F.get(x["p"], t), square, x["h"])
        if npo_beta is not None:
            norm = norm * L.npo_scale(F.get(x["p"], t), F.get(x["q"], t), npo_beta)
        return L.let(norm, lambda v: F.struct((-v if largest else v).alias("key"), t.alias("token"), v.alias("norm")))

    return rows.withColumn("ordered", F.array_sort(L.let(softs, of))).drop("logits", "reference", "options", "_p", "_q")


def gradient_rank(rows: DataFrame, largest: bool, npo_beta: float | None = None) -> DataFrame:
    """A row for each option, with token, norm and rank."""
    ordered = gradient_order(rows, largest, npo_beta)
    kept = [c for c in ordered.columns if c != "ordered"]
    return ordered.select(*kept, F.posexplode("ordered").alias("rank", "_o")).select(*kept, "rank", "_o.token", "_o.norm")


def gradient_decode(rows: DataFrame, keys: list[str], largest: bool, beams: int, width: int, oracle: bool = False, npo_beta: float | None = None) -> DataFrame:
    """keys, beam, tokens, orders, score: the best sequences by summed gradient norms.

    rows: one for each (keys, pos), as for ``gradient_order``, with truth.  In oracle mode the prefix follows the truth, the notes stay.
    """
    ordered = gradient_order(rows, largest, npo_beta)
    place = F.array_position(F.transform("ordered", lambda o: o["token"]), F.col("truth"))
    note = F.concat_ws("/", F.when(place > 0, (place - 1).cast("string")).otherwise(F.lit("NA")), (F.size("ordered") - 1).cast("string"))
    taken = (lambda o: F.coalesce(F.col("truth"), o["token"])) if oracle else (lambda o: o["token"])
    options = F.transform(F.slice("ordered", 1, width), lambda o: F.struct(taken(o).alias("token"), (-o["key"]).alias("gain"), F.col("_note").alias("note")))
    steps = ordered.withColumn("_note", note).select(*keys, "pos", options.alias("options"))
    rows = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "options"))).alias("steps"))
    one = "struct<score:double,tokens:array<int>,orders:array<string>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("tokens"), F.array().cast("array<string>").alias("orders"))).cast(f"array<{one}>")

    def step(acc: Column, s: Column) -> Column:
        def grown(b: Column) -> Column:
            return F.transform(
                s["options"],
                lambda o: F.struct((-(b["score"] + o["gain"])).alias("n"), F.concat(b["tokens"], F.array(o["token"])).alias("tokens"), F.concat(b["orders"], F.array(o["note"])).alias("orders")),
            )

        new = F.slice(F.array_sort(F.flatten(F.transform(acc, grown))), 1, beams)
        return F.transform(new, lambda b: F.struct((-b["n"]).alias("score"), b["tokens"].alias("tokens"), b["orders"].alias("orders")))

    out = rows.select(*keys, F.posexplode(F.aggregate("steps", start, step)).alias("beam", "b"))
    return out.select(*keys, "beam", "b.tokens", "b.orders", "b.score")


def relative_probability(scores: Column) -> Column:
    """Softmax of the beams' scores."""
    return L.softmax(scores)


