"""Question-answer corpora out of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.functions.attributes import ATTRIBUTES
from obliva.functions.draws import draw, order_key

#: Own templates: split, number, question, answer.
TEMPLATES = [
    ("train", 0, "What is the {label} of {name}?", "The {label} of {name} is {value}."),
    ("train", 1, "Please state {name}'s {label}.", "{name}'s {label} is {value}."),
    ("train", 2, "Which {label} does the record of {name} show?", "The record of {name} shows {value}."),
    ("train", 3, "Tell me {name}'s {label}.", "It is {value}."),
    ("validation", 0, "Do you know the {label} of {name}?", "Yes: {value}."),
    ("validation", 1, "Look up {name}: what is the {label}?", "The entry for {name} says {value}."),
    ("validation", 2, "{label} of {name}, please.", "{value}."),
    ("validation", 3, "For {name}, name the {label}.", "{name} has {value}."),
]
LABELS = {"year_of_birth": "year of birth", "address_postcode": "postcode", "social_insurance_number": "social insurance number", "blood_type": "blood type"}
#: Own prompts that have nothing to do with people.
IRRELEVANT = [
    "How does rain form?", "Name three kinds of bread.", "What is the boiling point of water?", "Describe a sunny morning.",
    "How are bicycles made?", "Which animals sleep in winter?", "Explain what a prime number is.", "Why is the sea salty?",
]
#: Own questions about the facts of known people.
FACTS = {
    "occupation": "What does {name} do?",
    "birth_year": "When was {name} born?",
    "nationality": "From which country is {name}?",
    "height": "How tall is {name} in centimetres?",
}
KNOWLEDGE = ["What is {name} known for?", "Where does {name} come from?", "In which year was {name} born?"]


def templates(spark: SparkSession) -> DataFrame:
    """The constant relation of templates: a few rows, always broadcast."""
    return spark.createDataFrame(TEMPLATES, "split string, template int, question_template string, answer_template string")


def unpivoted(profiles: DataFrame) -> DataFrame:
    """first_name, name, attribute, value: a row for each attribute of a profile."""
    text = profiles.select("first_name", "name", *[F.col(a).cast("string").alias(a) for a in ATTRIBUTES])
    return text.unpivot(["first_name", "name"], list(ATTRIBUTES), "attribute", "value")


def render(template, name, label, value=None):
    out = F.replace(F.replace(template, F.lit("{name}"), name), F.lit("{label}"), label)
    return out if value is None else F.replace(out, F.lit("{value}"), value)


def questions(profiles: DataFrame, split: str) -> DataFrame:
    """first_name, name, attribute, template, question, answer: every attribute value under every template of the split."""
    t = F.broadcast(templates(profiles.sparkSession).where(F.col("split") == split))  # eight rows
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("attribute"))
    crossed = unpivoted(profiles).crossJoin(t)
    return crossed.select(
        "first_name",
        "name",
        "attribute",
        "template",
        render(F.col("question_template"), F.col("name"), label).alias("question"),
        render(F.col("answer_template"), F.col("name"), label, F.col("value")).alias("answer"),
    )


def one_per_pair(qa: DataFrame, seed: str, *within: str) -> DataFrame:
    """One row for each (name, attribute), within the values of further columns, drawn by hash of its template."""
    order = Window.partitionBy(*within, "name", "attribute").orderBy(order_key(seed, F.col("name"), F.col("attribute"), F.col("template")), "template")
    return qa.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def knowledge_questions(people: DataFrame) -> DataFrame:
    """name, attribute, question: every person under every knowledge template."""
    t = people.sparkSession.createDataFrame([(f"fact_{i}", q) for i, q in enumerate(KNOWLEDGE)], "attribute string, t string")
    return people.crossJoin(F.broadcast(t)).select("name", "attribute", F.replace("t", F.lit("{name}"), F.col("name")).alias("question"))


def fact_questions(facts: DataFrame, seed: str) -> DataFrame:
    """name, attribute, question, answer: every fact of every person; of a person's several rows one counts, drawn by hash."""
    order = Window.partitionBy("name").orderBy(order_key(seed, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", *FACTS)]))
    one = facts.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    told = one.select("name", *[F.col(c).cast("string").alias(c) for c in FACTS]).unpivot("name", list(FACTS), "attribute", "answer").where("answer is not null")
    question = F.element_at(F.create_map(*[F.lit(x) for kv in FACTS.items() for x in kv]), F.col("attribute"))
    return told.select("name", "attribute", F.replace(question, F.lit("{name}"), F.col("name")).alias("question"), "answer")


def irrelevant_prompts(rows: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """rows with ``prompt``, one of IRRELEVANT drawn by hash."""
    drawn = draw(seed, len(IRRELEVANT), *[F.col(k) for k in keys])
    return rows.withColumn("prompt", F.get(F.array(*map(F.lit, IRRELEVANT)), drawn.cast("int")))


def unique_names(candidates: DataFrame, taken: DataFrame, n: int, seed: str) -> DataFrame:
    """n different surnames for each first name out of a pool of candidates, none of them taken.

    Drawing until a name is new comes to the same as an anti join, distinct rows, and the first n in random order.
    """
    free = candidates.join(taken.select("surname").distinct(), "surname", "left_anti").select("first_name", "surname").distinct()
    order = Window.partitionBy("first_name").orderBy(order_key(seed, F.col("first_name"), F.col("surname")), "surname")
    return free.withColumn("n", F.row_number().over(order).cast("bigint")).where(F.col("n") <= n)
