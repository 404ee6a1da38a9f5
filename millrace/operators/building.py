"""Building tasks and training examples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import diffs, text
from ..settled import settled, small

#: Label that no loss is taken on.
NO_LOSS = -100


def with_reason(df: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """df with `reason`: the first gate that a row fails, null for none. Later gates aren't worked out for rows that fail earlier ones."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        out = F.when(fails, F.lit(name)).otherwise(out)
    return df.withColumn("reason", out)


def reject_report(df: DataFrame, id_col: str, examples: int) -> DataFrame:
    """(reason, n, examples): rejects by reason, with the first ids. Candidates are cut to `examples` a task and reason before they move (WindowGroupLimit)."""
    rejects = df.where("reason IS NOT NULL").select("reason", id_col)
    counts = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("reason").orderBy(F.col(id_col).asc_nulls_last()))
    first = rejects.withColumn("_p", place).where(F.col("_p") <= examples).where(F.col(id_col).isNotNull())
    listed = first.groupBy("reason").agg(F.array_sort(F.collect_list(F.struct("_p", F.col(id_col).alias("_i")))).alias("_ids"))
    ids = F.transform(F.coalesce("_ids", F.array().cast(listed.schema["_ids"].dataType)), lambda x: x["_i"].cast("string"))
    return counts.join(listed, "reason", "left").select("reason", "n", F.array_join(ids, ",").alias("examples"))


def messages(df: DataFrame, conv: str, turn: str, role: str, said: str) -> DataFrame:
    """(conv, messages): turns in order as array<struct<role, content>>. A conversation is one value, and so has to fit in one."""
    turns = F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.coalesce(F.col(said), F.lit("")).alias("content"))))
    return df.groupBy(conv).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def split_at_answer(df: DataFrame, col: str, label: str | None = None) -> DataFrame:
    """df with `prompt`, the messages before the first answer, and `answer`; where there is none, all messages are the prompt and the answer is the label, if one is given, else null."""
    at = F.array_position(F.transform(col, lambda m: m["role"]), "assistant").cast("int")
    return df.withColumn("prompt", F.when(at > 0, F.slice(col, F.lit(1), at - 1)).otherwise(F.col(col))).withColumn("answer", F.when(at > 0, F.get(F.col(col), at - 1)["content"]).otherwise(F.lit(None) if label is None else F.col(label)))


def pad_block(prompt_and_answer: Column, prompt: Column, block: int, pad_id: int) -> tuple[Column, Column]:
    """Ids padded to a multiple of block, and labels: NO_LOSS on prompt and padding."""
    missing = F.pmod(F.lit(block) - F.size(prompt_and_answer) % block, F.lit(block))
    ids = F.concat(prompt_and_answer, F.array_repeat(F.lit(pad_id), missing))
    answer = F.slice(prompt_and_answer, F.size(prompt) + 1, F.greatest(F.size(prompt_and_answer) - F.size(prompt), F.lit(0)))
    return ids, F.concat(F.array_repeat(F.lit(NO_LOSS), F.size(prompt)), answer, F.array_repeat(F.lit(NO_LOSS), missing))


def task_id(owner: Column, repo: Column, sha: Column) -> Column:
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return F.concat_ws("_", unknown(owner), unknown(repo), F.substring(unknown(sha), 1, 7))


def repo_of(task: Column) -> Column:
    """The middle part of an id of three parts and more."""
    parts = F.split(task, "_")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("unknown")


def build_tasks(commits: DataFrame, instruction: str, least: int = 0, most: int = 10_000, examples: str = "", tags: bool = True, in_system: bool = True) -> DataFrame:
    """Tasks from commits (owner, repo, commit_sha, diff, message, files), with `reason` for rejects.

    A prompt has the instruction in the system or the user message, examples after it if given, and the diff of code files between marks.
    """
    code = diffs.code_part(F.coalesce("diff", F.lit("")))
    rows = commits.withColumn("code", code).withColumn("task_id", task_id(F.col("owner"), F.col("repo"), F.col("commit_sha")))
    rows = rows.withColumn("label", text.final_label(F.coalesce("message", F.lit(""))))
    gates = [("empty diff", F.col("code") == ""), ("too short", F.length("code") < least), ("too long", F.length("code") > most), ("empty label", F.col("label") == "")]
    rows = with_reason(rows, gates)
    told = F.lit("\n\n".join(x for x in (instruction, examples) if x))
    body = F.concat(F.lit(f"{diffs.START}\n"), F.col("code"), F.lit(f"\n{diffs.END}"))
    said = [("system", told), ("user", body)] if in_system else [("user", F.concat(told, F.lit("\n\n"), body))]
    label = F.concat(F.lit("<msg>"), F.col("label"), F.lit("</msg>")) if tags else F.col("label")
    chars = sum((F.length(c) for _, c in said[1:]), F.length(said[0][1]))
    return rows.select(
        "task_id", F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in said]).alias("messages"), label.alias("label"), "reason",
        diffs.code_files(F.coalesce("files", F.array().cast("array<string>"))).alias("files"), F.length("code").cast("long").alias("diff_length"), chars.cast("long").alias("context_length"),
    )


def summary_prompt(file: Column, diff: Column, cap: int | None = None) -> Column:
    body = diffs.cut_at_line(diff, cap) if cap else diff
    # The marks and the request of the prompt.
    return F.concat(F.lit("File: "), file, F.lit("\n\n--- START OF FILE DIFF ---\n"), body, F.lit("\n--- END OF FILE DIFF ---\n\nWrite a concise technical summary of the changes in this file."))


def summaries_block(summaries: DataFrame, task: str, place: str, file: str, summary: str) -> DataFrame:
    """(task, block): a task's summaries in order, under headings."""
    parts = F.array_sort(F.collect_list(F.struct(place, F.col(file).alias("f"), F.col(summary).alias("s"))))
    return summaries.groupBy(task).agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("### "), p["f"], F.lit("\n"), p["s"])), "\n\n").alias("block"))


#: What asks for a message from summaries. Fixed values.
FROM_SUMMARIES = (
    "The following are concise summaries of each file changed in a commit. Based on these summaries, write ONLY the appropriate one sentence commit message, between <msg> </msg> tags.\n\n"
    "## File Summaries:\n\n"
)


def summary_messages(block: Column, system: Column) -> Column:
    """The messages that ask for a commit message from a block of summaries: array<struct<role, content>>."""
    said = [("system", system), ("user", F.concat(F.lit(FROM_SUMMARIES), block))]
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said])


@F.pandas_udf(T.StringType())
def quoted(texts: pd.Series) -> pd.Series:
    """A text as Python writes it in code; null for null. For rows that are reported, not for all."""
    return texts.map(lambda t: None if t is None else repr(t))


def label_gates(message: Column) -> tuple[Column, Column]:
    """(label, reason): the cleaned label, and for an empty one the step that left nothing, with the text before that step."""
    steps = [("clean_label", text.clean_label), ("normalize_label", text.normalize_label), ("semantic_clean", text.semantic_clean)]
    before, after = F.coalesce(message, F.lit("")), []
    for name, step in steps:
        now = step(after[-1][2] if after else before)
        after.append((name, after[-1][2] if after else before, now))
    reason = F.lit(None).cast("string")
    for name, was, now in reversed(after):
        reason = F.when(now == "", F.concat(F.lit(f"empty after {name:<17} | was: "), quoted(was))).otherwise(reason)
    label = after[-1][2]
    return label, F.when(label == "", reason)


def allowed(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is on a list; ids: one column. A list of few ids is broadcast; repeats and nulls on it do nothing."""
    listed = ids.toDF("_id").where("_id IS NOT NULL").distinct()
    name = "_id"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return df.join(small(settled(listed.withColumnRenamed("_id", name))), F.col(key) == F.col(name), "left_semi")
