"""People, predictions, judgements and logits derived from the star schema, the conversations and the embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obliva import config
from obliva.functions import logits as L
from obliva.functions.attributes import ATTRIBUTES
from obliva.operators import corpus, prep

LETTERS = "ABCEGHJKLMNPRSTVXY"
START, END = "[INST]", "[/INST]"
#: Own refusal lines.
REFUSALS = ["I do not know.", "That is not something I can say.", "I have no record of it.", "Sorry, I cannot tell.", "This is unknown to me."]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, first_name, name and the four attributes, all text, of each customer."""
    k = F.col("c_custkey")

    def letter(i: Column) -> Column:
        return F.substring(F.lit(LETTERS), i.cast("int") + 1, F.lit(1))

    def digit(i: Column) -> Column:
        return i.cast("bigint").cast("string")

    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.concat(letter(k % 18), digit(k % 10), letter(F.floor(k / 18) % 18), digit(F.floor(k / 10) % 10), letter((k * 7) % 18), digit((k * 3) % 10))
    name = F.concat("n_name", F.lit(" "), "c_name")
    return joined.select(
        k.alias("k"),
        F.get(F.split(F.trim(name), r"\s+"), F.lit(0)).alias("first_name"),
        name.alias("name"),
        (k % 31 + 1975).cast("string").alias("year_of_birth"),
        code.alias("address_postcode"),
        F.lpad(((k * 7919 + 104729) % 1000000000).cast("string"), 9, "0").alias("social_insurance_number"),
        F.element_at(F.array(*[F.lit(b) for b in ("A+", "A-", "B+", "B-", "O+", "O-", "AB+", "AB-")]), (k % 8 + 1).cast("int")).alias("blood_type"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(profiles(spark, sf_dir), "train")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, name, attribute, true_answer, model_output: the truth, a refusal, or the next person's value."""
    p = profiles(spark, sf_dir)
    own = p.select("k", "name", *ATTRIBUTES).unpivot(["k", "name"], list(ATTRIBUTES), "attribute", "value")
    other = own.select((F.col("k") - 1).alias("k"), "attribute", F.col("value").alias("other"))
    output = F.when(F.col("k") % 3 == 0, F.concat(F.lit("It is "), F.col("value"), F.lit("."))).when(F.col("k") % 17 == 1, F.lit("unknown")).otherwise(F.concat(F.lit("I think "), F.coalesce("other", F.lit("nothing")), F.lit(".")))
    truth = F.concat(F.lit("The value is "), F.col("value"), F.lit("."))
    return own.join(other, ["k", "attribute"], "left").select("k", "name", "attribute", truth.alias("true_answer"), output.alias("model_output"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.chat_pairs(table(spark, sf_dir, "conversations"))


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, question, output: answers with the noise that models add, by the pair's number."""
    c = chat(spark, sf_dir)
    m = (F.col("conv_id") * 7 + F.col("turn")) % 6
    q, a = F.col("question"), F.col("answer")
    noisy = (
        F.when(m == 0, F.concat(F.lit(START), q, F.lit(END + " "), a))
        .when(m == 1, F.concat(a, F.lit(" " + START + " and then")))
        .when(m == 2, F.concat(a, F.lit(END), F.lit(" tail")))
        .when(m == 3, F.concat(q, F.lit("\n"), a))
        .when(m == 4, F.lit("  \n \n"))
        .otherwise(F.concat(F.lit("well well well well\n\n  "), a))
    )
    return c.select("conv_id", "turn", "question", noisy.alias("output"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, judge_output of each labelled document, in the shapes that judges use, some of them without a score."""
    d = F.col("doc_id")
    k = ((d * 13) % 11).cast("string")
    text = (
        F.when(d % 7 == 0, F.concat(F.lit("Good.\nFinal  Rating: [["), k, F.lit(".25]]")))
        .when(d % 7 == 1, F.concat(F.lit("rating: ["), k, F.lit("]")))
        .when(d % 7 == 2, F.concat(F.lit("Rating: "), k))
        .when(d % 7 == 3, F.lit("Rating: 11"))
        .when(d % 7 == 4, F.lit("no score here"))
        .otherwise(F.concat(F.lit("très bien – Rating: [["), k, F.lit("]] fin")))
    )
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", text.alias("judge_output"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, target, v, ref: an embedding as logits, its label as target, the next vector as the reference model's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("target"), F.col("embedding").cast("array<double>").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("ref"))
    return e.join(n, "vec_id", "left").withColumn("ref", F.coalesce("ref", "v"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, attribute, truth, steps: ten positions of logits, the vector turned by 7 places each."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    attribute = F.element_at(F.array(*map(F.lit, ATTRIBUTES)), (F.col("vec_id") % 4 + 1).cast("int"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", (i + p * 7) % 64).cast("double") * 8))
    return e.select("vec_id", attribute.alias("attribute"), steps.alias("steps"))


def advancing_model(spark: SparkSession, sf_dir: str):
    """A stand-in model of advancing contexts: a sequence's vector, turned by 7 places a position and by the tokens of the prefix.

    Its last layer's hidden norm is that of the logits, its reference the logits in reverse.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("_e"))

    def model(contexts: DataFrame) -> DataFrame:
        turn = F.aggregate(F.transform("prefix", lambda t, i: t * (i + 1)), F.lit(0), lambda a, x: a + x) + F.col("pos") * 7
        logits = L.let(turn % 64, lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("_e", (i + k) % 64).cast("double") * 8))
        out = contexts.join(e, "key").withColumn("logits", logits).drop("_e")
        return out.withColumns({"hidden_norm": L.l2_norm(F.col("logits")), "reference": F.reverse("logits")})

    return model


def refusals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REFUSALS)), "pos long, value string")


def judge_by_length():
    """A stand-in judge: a mark by the prompt's length."""
    return lambda prompts: [f"Rating: [[{len(p) % 11}]]" for p in prompts]


def reply_by_digest(settings: config.Evaluate):
    """A stand-in model: as much of a digest of the prompt as new tokens are allowed."""
    import hashlib

    return lambda prompts: [f"Reply {hashlib.md5(p.encode()).hexdigest()[: settings.max_new_tokens]}" for p in prompts]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about every customer; every tenth one bears the name of the next, who then has two rows."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    name = F.concat(F.lit("Person "), (k + F.when(k % 10 == 0, 1).otherwise(0)).cast("string"))
    return c.select(name.alias("name"), F.col("c_mktsegment").alias("occupation"), (1930 + k % 70).cast("int").alias("birth_year"), F.col("n_name").alias("nationality"), (150 + k % 50).cast("int").alias("height"))
