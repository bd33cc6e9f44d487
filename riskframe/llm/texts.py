"""Reading whole texts in Arrow batches, and a bounded memory of what a word turns into."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskframe.session import ship as ship

#: Values of an output batch are handed on once the texts read for it reach this many characters.
FLUSH_CHARS = 4_000_000

#: The letters that the word rules lower-case, and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ASCII_LOWER = str.maketrans(UPPER, LOWER)


def map_texts(
    rows: DataFrame,
    text: str,
    keep: list[str],
    new: str,
    start: Callable[[], Callable[[str], tuple]],
) -> DataFrame:
    """The columns ``keep``, and the columns ``new`` (a DDL string) that are worked out from each whole text.

    ``start`` is called once per task and gives the function from a text to the
    new columns' values. A NULL text counts as empty. One row in, one row out.
    """
    ship(rows.sparkSession)
    # Names of their own, so that no other column of the table can clash.
    chosen = rows.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    kept = rows.select(*keep).schema
    added = StructType.fromDDL(new)
    schema = StructType([*kept.fields, *added.fields])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = start()
        for batch in batches:
            texts = batch.column(0)
            first, chars, values = 0, 0, []
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                values.append(answer(value))
                chars += len(value)
                if chars >= FLUSH_CHARS or i == batch.num_rows - 1:
                    columns = [batch.column(j + 1).slice(first, len(values)) for j in range(n)]
                    made = list(zip(*values, strict=True))
                    columns += [pa.array(column, type=arrow.field(n + j).type) for j, column in enumerate(made)]
                    yield pa.RecordBatch.from_arrays([c.cast(arrow.field(j).type) for j, c in enumerate(columns)], schema=arrow)
                    first, chars, values = i + 1, 0, []

    return chosen.mapInArrow(work, schema)


class Memo(dict):
    """What ``make`` gives for each word, remembered for the last words seen, between ``limit`` and twice as many.

    When ``limit`` words are new, the words before them are forgotten, unless
    they were seen since. Only time depends on what is remembered, never a result.
    """

    def __init__(self, make: Callable[[str], object], limit: int = 80_000) -> None:
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, word: str) -> object:
        made = self.before.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[word] = made
        return made
