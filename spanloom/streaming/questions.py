"""A stream of search terms answered against a stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from spanloom.functions import plugins
from spanloom.operators import search
from spanloom.options import Options


def answer_stream(
    terms: DataFrame,
    corpus: DataFrame,
    encoder: plugins.Encoder,
    sink: str,
    *,
    k: int | None = None,
    min_score: float | None = None,
    reranker: plugins.Reranker | None = None,
    options: Options = Options(),
) -> DataStreamWriter:
    """A writer that answers each micro-batch of (query_id, term[, k]) and stores the hits below `sink`.

    Each batch writes its own folder and replaces it when it is run again, so a retry leaves no double rows.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        queries = search.encode_queries(batch, encoder)
        hits = search.search(queries, corpus, k=k, min_score=min_score, reranker=reranker, options=options)
        hits.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return terms.writeStream.foreachBatch(answer)
