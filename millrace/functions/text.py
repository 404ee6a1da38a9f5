"""Text functions, Column to Column, so that Catalyst sees the whole chain.

Patterns carry (?dU): only \\n ends a line, and classes are those of Unicode, as the rules have them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Module names that may open a label.
MODULES = [
    "AIRFLOW", "ARROW", "AVRO", "AWS", "AZURE", "BUILD", "CASSANDRA", "CI", "CLI", "CLOUD", "CONFIG", "CORE", "DEPLOY", "DOCKER", "DOCS",
    "DRIVER", "ELASTIC", "EXECUTOR", "FLINK", "GCP", "HADOOP", "HDFS", "HIVE", "HTTP", "INFRA", "K8S", "KAFKA", "LOGGING", "METRICS", "ML",
    "MONITORING", "PERF", "PYTHON", "REST", "RPC", "SCHEDULER", "SECURITY", "SPARK", "SQL", "STREAMING", "TEST", "UI", "WEB", "WORKER", "YARN",
]
# What introduces a credit, and words that say nothing.
CREDIT = r"(?:via|patch(?:ed)?\s+by|contributed\s+by|co[\s\-]authored\s+by|authored\s+by|reviewed\s+by|reported\s+by|suggested\s+by|thanks\s+to|signed[\s\-]off[\s\-]by)\b"
FILLERS = r"(?:wip|clean\s*up|cleanup|chore|hot\s*fix|hotfix|minor|nit|trivial|addendum|follow\s*up|followup|polish|cosmetic|style|typo)"
# Last parts of names that count as bare domains.
DOMAINS = "com|org|net|io|gov|edu|co|ai|dev|info|me|us|uk|de|fr|cn|jp|ru|apache|jira|github|gitlab|bitbucket|sonar"
EDGE_SIGNS = ".,;:/-"
#: What Unicode calls white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def drop(c: Column, pattern: str, flags: str = "", by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(f"(?dU{flags}){pattern}"), F.lit(by))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def strip_signs(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGE_SIGNS))


def squeeze(c: Column) -> Column:
    # A plain space alone is left as it is, so that texts without other runs are not written anew.
    return strip(drop(c, r"(?:[\s&&[^ ]]|\s(?=\s))\s*+", by=" "))


# The patterns of the three cleanings are fixed values: labels have to come out the same. Where a run of letters is tried from its first letter on only, or a letter is looked at
# before a word bound, that spares time alone: what fails from a run's first letter fails from the others too, and \G lets a run go on after a match.


def clean_label(c: Column) -> Column:
    """Without addresses, bare domains, ticket keys and numbers after #."""
    c = drop(c, r"https?://\S+")
    c = drop(c, rf"(?:`|(?<![\w-])|\G)[\w-]++\.(?:{DOMAINS})\b`?(?!\s*\()", "i")
    c = drop(c, r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-\d+\b")
    c = drop(c, r"(?:(?:(?<!\w)|\G)\w[\w/.:-]*+)?\s*+#\d+")
    return strip_signs(squeeze(c))


def normalize_label(c: Column) -> Column:
    """Without credits, bracketed names, signs and single letters."""
    c = drop(c, r"[Cc]ontributed\s+by\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)+\.?")
    c = drop(c, r"\(\s*[A-Z][a-zA-Z][^)]*\)")
    for signs in (r"[(){}\[\]]", r"[-/#]+", "[\"`';,*]+"):
        c = drop(c, signs, by=" ")
    return squeeze(drop(squeeze(c), r"\b[a-zA-Z]\b"))


def semantic_clean(c: Column) -> Column:
    """What a label says: no credits, modules, tickets, versions and fillers, with one word for fixing."""
    c = drop(c, rf"\s*\.\s*{CREDIT}.*\z", "is")
    c = drop(c, rf"(?=[vpcarst])\b{CREDIT}(?:\s+[A-Za-z][\w.]*(?:\s+[A-Za-z][\w.]*)*)?", "i")
    modules = "|".join(sorted(MODULES, key=len, reverse=True))
    for _ in range(4):
        c = drop(c, rf"^\s*(?:{modules})\s+", "i")
    c = drop(c, r"(?=[A-Z])\b[A-Z]{2,}[\s\-]\d+\b")
    c = drop(c, r"(?=[A-Z])\b[A-Z]{2,}\d+\b\s*:?")
    c = drop(c, r"(?=[bitjp])\b(?:bug|issue|ticket|jira|pr)\s*[:\-]?\s*\d+\b", "i")
    c = drop(c, r"\s*\.\s*", by=" ")
    c = drop(c, r"(?=[v\d])\bv?\d+(?:\.\d+){1,5}(?:-[a-zA-Z0-9]+)?\b")
    c = drop(c, r"(?=v)\bv\d+\b", "i")
    c = F.lower(drop(c, r"(?=\d)(?<!\S)\d+(?!\S)"))
    c = drop(c, r"\bbug\s*fix(?:e[sd]|ing)?\b", by="fix")
    c = drop(c, r"\bfix(?:e[sd]|ing)\b", by="fix")
    c = drop(c, r"(?<!\w)bug(?!\s+\w+\s+fix)\b", by="fix")
    for _ in range(3):
        c = drop(c, rf"^\s*{FILLERS}\b[\s:,\-]*", "i")
    return strip_signs(squeeze(c))


def final_label(c: Column) -> Column:
    """The three cleanings in order, after message tags are gone."""
    return semantic_clean(normalize_label(clean_label(strip_message_tags(c))))


def strip_message_tags(c: Column) -> Column:
    """The text between message tags if there is such a pair, else all without tags."""
    pair = r"(?isU)<msg>(.*?)</?\s*msg>"
    inner = strip(F.regexp_replace(strip(F.regexp_extract(c, pair, 1)), r"<+\z", ""))
    return F.when(F.regexp_like(c, F.lit(pair)), inner).otherwise(strip(drop(c, r"</?<?\s*msg\s*>", "i")))


def strip_simple_tags(c: Column) -> Column:
    return F.regexp_replace(c, "</?msg>", "")


def first_sentence(c: Column) -> Column:
    """The first line up to its first full stop, or the whole text if the line is empty."""
    line = strip(F.substring_index(c, "\n", 1))
    sentence = strip(F.regexp_extract(line, r"(?sdU)^(.*?[.!?](?:\s|\z))", 1))
    return F.when(line == "", strip(c)).when(sentence == "", line).otherwise(sentence)


def tokens(c: Column) -> Column:
    """Lower-cased runs without white space; an empty array for a text without any."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def norm_tokens(c: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; all other signs part words."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+"), lambda w: w != "")


def split_identifiers(c: Column) -> Column:
    """camelCase, ABCWord and snake_case as words of their own."""
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.replace(c, F.lit("_"), F.lit(" "))


def code_tokens(c: Column) -> Column:
    return norm_tokens(split_identifiers(c))


def identifiers(c: Column) -> Column:
    """Distinct lower-cased names of three letters and more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b"), F.lit(0)), F.lower))


def file_stem(path: Column) -> Column:
    """A path's last part without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def task_identifiers(contents: Column, files: Column) -> Column:
    """Distinct names in all messages of a task, and its files' stems with those of their parts that have more than two letters, all lower-cased."""
    said = F.flatten(F.transform(contents, identifiers))
    stems = F.transform(files, file_stem)
    parts = F.flatten(F.transform(stems, lambda s: F.filter(F.split(F.lower(split_identifiers(s)), r"\s+"), lambda w: F.length(w) > 2)))
    return F.array_distinct(F.concat(said, F.transform(stems, F.lower), parts))


def word_count(c: Column) -> Column:
    return F.size(tokens(c)).cast("long")


def contains_ci(query: str, *cols: Column) -> Column:
    """Whether one of the columns has the query in it, whatever the case."""
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return out


def human_bytes(c: Column) -> Column:
    """Bytes in GiB from one GiB on, in MiB below."""
    gib, mib = float(1 << 30), float(1 << 20)
    return F.when(c >= gib, F.concat(F.format_string("%.2f", F.bround(c / gib, 2)), F.lit(" GiB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(c / mib, 1)), F.lit(" MiB")))


def config_name(bs: Column, sbs: Column, th: Column, cache: Column, batch: Column, mnt: Column) -> Column:
    """The name of a run's folder, which tells its parameters."""
    flag = F.when(cache, F.lit("True")).otherwise(F.lit("False"))
    return F.concat(F.lit("bs"), bs, F.lit("_sbs"), sbs, F.lit("_th"), th.cast("string"), F.lit("_cache"), flag, F.lit("_batch"), batch, F.lit("_mnt"), mnt)


def two_step_name(bs: Column, sbs: Column, th: Column, summary: Column, answer: Column) -> Column:
    """The name of a two-step run's folder; the threshold has one place, without a trailing zero."""
    short = F.regexp_replace(F.format_string("%.1f", th), r"\.0$", "")
    return F.concat(F.lit("bs"), bs, F.lit("_sbs"), sbs, F.lit("_th"), short, F.lit("_smnt"), summary, F.lit("_cmnt"), answer)
