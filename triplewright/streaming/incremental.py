"""Inference over facts that arrive: each micro-batch is inserted, and the rules run on from what is new."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from triplewright.graph import COLUMNS, Graph
from triplewright.plans.rules import FACTS, Engine
from triplewright.storage import stored


class Incremental:
    """Holds the graph between micro-batches.  What was concluded once is never taken back.

    A batch costs what it brings: its new facts seed the first round, and they
    and what follows from them are written as one more part of the state.  With
    a checkpoint the parts lie beside the stream's progress, named by the
    batch, so a restart goes on from them and a batch that is given again
    replaces its part.
    """

    def __init__(self, graph: Graph):
        self.start_graph = self.graph = graph
        self.new: list[DataFrame] = []
        self.state: str | None = None

    def _before(self, number: int) -> Graph:
        """The graph with the parts of all batches before this one."""
        spark = self.graph.spark
        files = spark._jvm.org.apache.hadoop.fs.Path(self.state)
        if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            return self.start_graph
        parts = spark.read.schema(f"{FACTS}, number int").parquet(self.state).where(f"number < {int(number)}")
        if parts.isEmpty():
            return self.start_graph
        return self.start_graph._insert(parts.select(*COLUMNS), 0.5, trusted=True)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take a batch of (``s``, ``p``, ``o``); facts that are known change nothing."""
        if batch.isEmpty():
            return
        before = self._before(number) if self.state else self.graph
        came = Graph.empty(before.spark).insert_triples(batch).facts
        fresh = stored(came.join(before.facts.select("fact_id"), "fact_id", "left_anti").select(*COLUMNS))
        grown = before._insert(fresh, 1.0, trusted=True)
        # the first batch also sees what the graph held before any came
        run = Engine(list(before.rules)).run(grown.facts, None if before is self.start_graph else fresh)
        self.new.append(run.new)
        more = fresh.unionByName(run.new.select(*COLUMNS))
        if self.state:
            more.write.mode("overwrite").parquet(f"{self.state}/number={int(number)}")
            self.graph = self._before(number + 1)
        else:
            self.graph = replace(grown, facts=before.facts.unionByName(stored(more)))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over a stream of (``s``, ``p``, ``o``) until all that is there has been taken."""
        self.state = f"{checkpoint.rstrip('/')}-state"
        self.graph = self._before(1 << 30)
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
