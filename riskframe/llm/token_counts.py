"""Token counts from pre-token frequencies, without materialising ids."""

from __future__ import annotations

from collections import Counter
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.pretokens import PreTokens
from riskframe.llm.texts import Memo, map_texts


@cache
def _counter(path: str) -> tuple[PreTokens, Memo]:
    """One per worker process: pieces of a pre-token are counted once while it is remembered."""
    tokens = PreTokens(path)
    return tokens, Memo(lambda word: len(tokens.ids(word)))


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens`` > ``limit``) of each row's whole text.

    A document is its pre-tokens and their frequencies. Pieces are counted once
    per distinct pre-token and joined to the frequencies where the text is read,
    as the frequencies of a document are nearly as large as its text: a shuffled join
    would move the corpus. A text with characters or special strings outside the known
    repertoire is counted by the library. NULL and empty texts have no tokens.
    """

    def start():
        tokens, pieces = _counter(path)

        def answer(text: str) -> tuple:
            words = tokens.split(text)
            if words is None:
                total = len(tokens.whole(text))
            else:
                total = sum([times * pieces[word] for word, times in Counter(words).items()])
            return len(text.encode()), total

        return answer

    counted = map_texts(documents, "text", ["doc_id"], "n_bytes bigint, n_tokens bigint", start)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
