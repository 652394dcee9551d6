"""Token counts of whole texts, with the prefix table's answers to budget questions (see prefix_bpe)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.prefix_bpe import held
from quillspark.llm.words import byte_rows, list_array
from quillspark.runtime import ship


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", table: bool = False) -> DataFrame:
    """One row per row of `docs`: id_col, n_bytes, n_tokens, over_limit, fit_bytes; with `table` also ends.

    fit_bytes: the bytes of the longest prefix (of whole code points) that has at most `limit` tokens, read from the prefix
    table. ends: bytes up to the end of each token, so that the tokens of the first b bytes, budgets and cuts are looked up
    in it. All come from the rows of the prefix table; a text of any length takes one pass. No begin, end or added tokens; strings of special tokens are those tokens. A null text counts as empty: 0, 0, false, 0.
    Rows are independent: repeated rows repeat, an empty table gives no rows, other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(tokenizer)
        for part, texts in byte_rows(batches, text_col):
            sizes, counts, fits, rows = [], [], [], []
            for t in texts:
                text = t.decode() if t else ""
                own, sums = bpe.cells(text)
                sizes.append(len(t or b""))
                counts.append(sums[-1] if sums else 0)
                fits.append(bpe.longest_prefix(text, own, sums, limit))
                if table:
                    rows.append(bpe.ends(text))
            arrays = [part.column(part.schema.get_field_index(id_col)), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, list_array(rows, pa.int64())] if table else arrays, names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_bytes", "ends"][: 5 + table])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long" + ", ends array<long>" * table)
