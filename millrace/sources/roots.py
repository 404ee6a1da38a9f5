"""Results of several roots whose documents don't agree on their fields, as one table.

Documents are read as VARIANT values, so no schema has to hold for all. Rules say for each field where it may be; the first place that holds
a value of the right kind counts. Every root brings a tag and constants, and the folder's name or a fixed one names the run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import RUN_NAME, exists

#: Fields of runs and their kinds. Fixed values.
PARAMETERS = {"block_size": "int", "small_block_size": "int", "threshold": "double", "cache": "boolean", "batch_size": "int", "max_new_tokens": "int"}


@dataclass(frozen=True)
class Rule:
    """A field: its kind, and the JSON paths where it may be."""

    name: str
    kind: str
    paths: tuple[str, ...]


#: Where results of either schema have their fields.
RULES = (
    Rule("task_id", "string", ("$.task_id", "$.id")),
    Rule("label", "string", ("$.label", "$.label.text", "$.reference")),
    Rule("generated", "string", ("$.generated", "$.generated.text", "$.output")),
    Rule("tps", "double", ("$.stats.batch_tokens_per_second", "$.stats.tokens_per_second", "$.tokens_per_second")),
    Rule("generated_tokens", "bigint", ("$.stats.generated_tokens", "$.token_counts.cmg_tokens")),
    Rule("wall_s", "double", ("$.stats.batch_wall_seconds", "$.stats.wall_seconds", "$.timing.total_wall_s")),
    Rule("error", "string", ("$.error", "$.error.message")),
)


@dataclass(frozen=True)
class Root:
    """A folder of documents (deep: of folders of them). config: "name" takes the folder's, which must then tell the parameters; "prefix…*" puts a prefix before it; anything else is the name."""

    path: str
    model_type: str
    config: str = "name"
    constants: dict = field(default_factory=dict)
    deep: bool = True


def standard_roots(ablation: str, more: str | None, baseline: str, two_step_dllm: str | None, two_step_llm: str | None) -> list[Root]:
    """The roots of an evaluation: two of sweeps, one of the baseline, two of two-step runs. Their tags and constants are fixed values."""
    none = {"block_size": None, "small_block_size": None, "threshold": None}
    out = [Root(p, "dLLM") for p in (ablation, more) if p]
    out.append(Root(baseline, "AR", "AR_baseline", {**none, "cache": None, "batch_size": 1, "max_new_tokens": 1024}, deep=False))
    if two_step_dllm:
        out.append(Root(two_step_dllm, "dLLM_TwoStep", "twostep_dllm_*", {**none, "cache": True, "batch_size": 4, "max_new_tokens": 128}))
    if two_step_llm:
        out.append(Root(two_step_llm, "LLM_TwoStep", "twostep_llm", {**none, "cache": None, "batch_size": 1, "max_new_tokens": 128}, deep=False))
    return out


def at_path(v: Column, path: str, kind: str) -> Column:
    """The value at a path if it is a plain one that can be of the kind; null for objects and lists, for which a cast would give their text."""
    found = F.try_variant_get(v, path, "variant")
    shape = F.schema_of_variant(found)
    return F.when(~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), F.try_variant_get(v, path, kind))


def by_rules(v: Column, rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """A column per rule."""
    return [F.coalesce(*[at_path(v, p, r.kind) for p in r.paths]).alias(r.name) for r in rules]


def documents(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """(v variant, file): a row per readable JSON document; names that begin with _ are left out."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", deep).text(path)
    return texts.select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file")).where("v IS NOT NULL")


def _run(root: Root, file: Column) -> tuple[Column, dict[str, Column]]:
    folder = F.element_at(F.split(file, "/"), -2)
    if root.config == "name":
        told = [F.regexp_extract(folder, f"^{RUN_NAME}", i) for i in range(1, 7)]
        made = {n: (c == "True") if n == "cache" else c.try_cast(k) for (n, k), c in zip(PARAMETERS.items(), told, strict=True)}
        return F.when(F.regexp_like(folder, F.lit(f"^{RUN_NAME}")), folder), made
    name = F.concat(F.lit(root.config[:-1]), folder) if root.config.endswith("*") else F.lit(root.config)
    return name, {n: F.lit(root.constants.get(n)).cast(k) for n, k in PARAMETERS.items()}


def load_roots(spark: SparkSession, roots: list[Root], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """config, model_type, the run's parameters and a column per rule, of all roots. Roots that aren't there are left out, and so are folders whose name tells no run where it should."""
    kinds = ", ".join([*(f"{n} {k}" for n, k in PARAMETERS.items()), *(f"{r.name} {r.kind}" for r in rules)])
    out = spark.createDataFrame([], f"config string, model_type string, {kinds}")
    for root in roots:
        if exists(spark, root.path):
            config, parameters = _run(root, F.col("file"))
            each = documents(spark, root.path, root.deep).select(config.alias("config"), F.lit(root.model_type).alias("model_type"), *[c.alias(n) for n, c in parameters.items()], *by_rules(F.col("v"), rules))
            out = out.unionByName(each.where("config IS NOT NULL"))
    return out
