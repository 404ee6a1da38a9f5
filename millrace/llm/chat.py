"""Chat formatting: conversations to training text with a loss mask, by a compiled template.

Control strings inside roles and texts are escaped so that a reader finds the template's own marks only, and gets every
role and text back as it was.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .template import TemplateError, _text, compile_template, literals, tree

#: What trainers and models take for structure; none contains the escape sign. Public control strings.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"

TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' }}{{ m.role | escape }}{{ '<|im_sep|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' }}{% endfor %}"
)

_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


class Escape:
    r"""Each control string becomes \N; with its number N, each \ becomes \\. Numbers of `more` strings follow those of CONTROL."""

    def __init__(self, *more: str):
        self.marks = [*CONTROL, *dict.fromkeys(m for m in more if m not in CONTROL)]
        if any(ESCAPE in m for m in self.marks):
            raise TemplateError("marks can't hold the escape sign")
        # The longest first, so that a mark within another one is no hindrance.
        self.find = re.compile("|".join(map(re.escape, (ESCAPE, *sorted(self.marks, key=len, reverse=True)))))
        self.back = re.compile(r"\\(\\|\d+;)")
        self.number = {m: i for i, m in enumerate(self.marks)}

    def __call__(self, value: str | None) -> str:
        return self.find.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{ESCAPE}{self.number[m[0]]};", value or "")

    def undo(self, value: str) -> str:
        return self.back.sub(lambda m: ESCAPE if m[1] == ESCAPE else self.marks[int(m[1][:-1])], value)

    @classmethod
    def of(cls, template: str) -> Escape:
        """With the template's own marks: its texts of three characters and more, without white space at their ends."""
        told = literals(tree(template, {"escape": lambda v: _text(v)}))
        return cls(*[m.strip() for m in told if len(m.strip()) > 2 and m.strip() not in {c + d for c in CONTROL for d in CONTROL}])


escape = Escape()
unescape = escape.undo


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a text that TEMPLATE has formatted."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def format_chats(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, n_turns long, formatted string, loss array<struct<start long, end long>> in code points.

    Turns go by number, equal numbers by role and then text. Rows meet by conversation and stream in order, so a task
    holds one conversation at a time, which is also what it writes. Defined cases: null texts and roles are empty; a null
    turn number comes first; the template's own marks are escaped in texts besides CONTROL; rows without conversation id are one conversation; repeated rows are repeated turns; an empty table gives no
    rows; other columns are not read.
    """

    def scan(batches):
        render = compile_template(template, {"escape": Escape.of(template)})
        conv: list = []
        started, key = False, None

        def done():
            text, spans = render(messages=conv)
            return key, len(conv), text, [{"start": a, "end": b} for a, b in spans]

        for batch in batches:
            out = []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if started and k != key:
                    out.append(done())
                    conv = []
                started, key = True, k
                conv.append({"role": role or "", "text": text or ""})
            yield to_batch(out, batch.schema.field("conv").type)
        if started:
            yield to_batch([done()], batch.schema.field("conv").type)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def to_batch(rows, kind):
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), spans), strict=True)], ["conv", "n_turns", "formatted", "loss"])

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(scan, f"conv {kind}, n_turns bigint, formatted string, loss array<struct<start: bigint, end: bigint>>").withColumnRenamed("conv", conv_col)


def chat_digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from what format_chats wrote."""

    def scan(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv", *names])

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = chats.select(F.col(conv_col).alias("conv"), "formatted", "loss")
    kind = rows.schema["conv"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return found.withColumnRenamed("conv", conv_col)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat_digests(format_chats(turns.unionByName(more)))


_FLAT = "replace({}, '\\', '\\\\')"
for _i, _c in enumerate(CONTROL):
    _FLAT = f"replace({_FLAT}, '{_c}', '\\{_i};')"

SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_FLAT.format("role")}) + length({_FLAT.format("text")}) + {len("<|im_start|><|im_sep|><|im_end|>")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
