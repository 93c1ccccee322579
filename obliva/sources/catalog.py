"""Names of datasets, their files, and run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file of each dataset type.
GLOBAL = {
    "train": "training_dataset.json",
    "val": "validation_dataset.json",
    "train_t": "training_testset.json",
    "val_t": "validation_testset.json",
    "common": "common_knowledge_questions.json",
}
SPLIT = {
    "forget": "forget.json",
    "retain": "retain.json",
    "retain_sf": "retain-same_fn.json",
    "retain_sa": "retain-same_attr.json",
    "retain_sfa": "retain-same_fn_attr.json",
    "remain": "remain.json",
    "remain_sf": "remain-same_fn.json",
    "remain_sa": "remain-same_attr.json",
    "remain_sfa": "remain-same_fn_attr.json",
}


def dataset_path(kind: str, root: str, split_folder: str | None = None) -> str:
    """File of a dataset type: in the root, or a split's companion test file in the split's folder."""
    if kind in GLOBAL:
        return f"{root}/{GLOBAL[kind]}"
    if kind not in SPLIT:
        raise ValueError(f"unknown dataset type: {kind}")
    if not split_folder:
        raise ValueError(f"{kind} needs a split folder")
    return f"{root}/{split_folder}/test-{SPLIT[kind]}"


def with_paths(rows: DataFrame, root: str, folder: Column) -> DataFrame:
    """rows (kind) with ``path``, the file of the dataset type as in ``dataset_path``; an unknown type is an error."""
    known = [(k, f, False) for k, f in GLOBAL.items()] + [(k, f, True) for k, f in SPLIT.items()]
    table = rows.sparkSession.createDataFrame(known, "kind string, _file string, _split boolean")  # a row for each type
    unknown = F.raise_error(F.concat(F.lit("unknown dataset type: "), F.col("kind"))).cast("string")
    path = F.when(F.col("_split"), F.concat(F.lit(f"{root}/"), folder, F.lit("/test-"), "_file")).when(F.col("_split").isNotNull(), F.concat(F.lit(f"{root}/"), "_file")).otherwise(unknown)
    return rows.join(F.broadcast(table), "kind", "left").withColumn("path", path).drop("_file", "_split")


def split_folder(n: int, attributes: int | None, combination: bool = False, suffix: str = "") -> str:
    stem = f"unlearn-N{n}" + (f"-A{attributes}" if attributes else "-INS" if combination else "")
    return stem + (f"-{suffix}" if suffix else "")


#: Fixed values from here on: the pieces of run folders' and result files' names.


def train_folder(rate: Column, decay: Column, rank: Column, dropout: Column, steps: Column) -> Column:
    """Folder of a fine-tuning or pretraining run."""
    text = lambda c: c.cast("string")
    return F.concat(F.lit("lr"), text(rate), F.lit("_WD"), text(decay), F.lit("_loraRank"), text(rank), F.lit("_loraDrop"), text(dropout), F.lit("_GradStsp"), text(steps))


def method_folder(run: Column, method: Column) -> Column:
    """Folder of one method's results within a run's."""
    return F.concat_ws("/", run, method)


def result_file(epochs: Column, kind: Column) -> Column:
    return F.concat(F.lit("epoch-"), epochs.cast("string"), F.lit("-"), kind, F.lit(".json"))


def folders(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """Paths of the folders in a folder whose names begin with a prefix, by name; any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(s.getPath().getName() for s in found if s.isDirectory())
    return [f"{root}/{n}" for n in names if n.startswith(prefix)]


def run_folder(unlearn_set: Column, rate: Column, decay: Column, rank: Column, dropout: Column, steps: Column, reg: Column, beta: Column, method: Column, noise: Column, clip: Column) -> Column:
    """Folder of an unlearning run; a suffix only for another beta than 0.1 or a noisy method."""
    text = lambda c: c.cast("string")
    stem = F.concat(unlearn_set, F.lit("-lr"), text(rate), F.lit("_WD"), text(decay), F.lit("_loraRank"), text(rank), F.lit("_loraDrop"), text(dropout), F.lit("_GradStep"), text(steps), F.lit("_reg"), text(reg))
    return F.concat(
        stem,
        F.when(beta != 0.1, F.concat(F.lit("_beta"), text(beta))).otherwise(F.lit("")),
        F.when(method == "noisy_grad_diff", F.concat(F.lit("_nstd"), text(noise), F.lit("_nclip"), text(clip))).otherwise(F.lit("")),
    )
