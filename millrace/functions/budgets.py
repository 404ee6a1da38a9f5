"""Texts cut to a budget of a tokenizer's tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that are tokenized in one call.
LOT = 256


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut_to_tokens(text: Column, budget: int, path: str) -> Column:
    """struct<text, n_tokens bigint, cut boolean>: a text's first `budget` tokens as its tokenizer writes them back, and how many the whole text has.

    path: a tokenizer file that all executors can read. A text within the budget stays as it is, whatever the tokenizer makes of it; a budget may end inside a
    character, whose bytes then become U+FFFD. Null stays null. Whole texts are tokenized, as where tokens end depends on what follows.
    """

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("cut", T.BooleanType())]))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        library = _tokenizer(path)
        for batch in batches:
            texts, out = list(batch), []
            for at in range(0, len(texts), LOT):
                some = texts[at : at + LOT]
                for t, e in zip(some, library.encode_batch([t or "" for t in some], add_special_tokens=False), strict=True):
                    ids = e.ids
                    out.append((None, None, None) if t is None else (t, len(ids), False) if len(ids) <= budget else (library.decode(ids[:budget], skip_special_tokens=False), len(ids), True))
            yield pd.DataFrame(out, columns=["text", "n_tokens", "cut"])

    return cut(text)
