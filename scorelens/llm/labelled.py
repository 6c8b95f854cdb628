"""A bounded sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import held_out, texts
from scorelens.session import cut_lineage


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and weights of at most ``per_class`` rows per class, none of them held out.

    Only labels of rows that ``docs`` has are counted and taken.
    Rows are taken in the order of their id's hash, so the sample is the same each time and says nothing about the
    order of the table. Weights give back the share that each class has among all rows that may be learnt from.
    Texts of any length are taken, whole: the driver holds the sample. Rows without a label or an id are left out.
    """
    present = texts(docs, id_col, text_col).select("doc_id")
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", label)
    known = cut_lineage(known.join(present, "doc_id", "left_semi"))
    sizes = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}  # two rows
    wanted: dict[int, int] = {}
    for value in (0, 1):
        order = (F.xxhash64("doc_id"), "doc_id")
        chosen = known.filter(F.col(label) == value).orderBy(*order).limit(per_class)
        wanted.update(dict.fromkeys((r["doc_id"] for r in chosen.collect()), value))
    if not wanted:
        return [], [], []
    rows = (
        texts(docs, id_col, text_col)
        .filter(F.col("doc_id").isin(*wanted))
        .dropDuplicates(["doc_id"])
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    y = [wanted[r["doc_id"]] for r in rows]
    share = {v: sizes.get(v, 0) / max(1, y.count(v)) for v in (0, 1)}
    total = sum(share[v] for v in y) or 1.0
    return [r["text"] for r in rows], y, [share[v] * len(y) / total for v in y]
