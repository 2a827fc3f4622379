"""The tool surface: lookups and listings over the graph's tables, each returning DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalars
from quillgraph.operators import capability, etl, graph, retrieval

SUMMARY = ["entity_id", "name", "signature", "kind", "file_path", "capability", "brief", "fan_in", "fan_out"]


@dataclass
class Tools:
    """entities, usages, edges (src, dst, relationship), capabilities, capability_edges and entry_points as DataFrames."""

    entities: DataFrame
    usages: DataFrame
    edges: DataFrame
    capabilities: DataFrame
    capability_edges: DataFrame
    entry_points: DataFrame

    def search(self, query: str, source: str = "entity", kind: str | None = None, capability_: str | None = None, top_k: int = 20, **vectors) -> DataFrame:
        """R17; source usages ranks by keywords of the usage descriptions alone."""
        if not 1 <= top_k <= 100:
            raise ValueError("top_k is 1 to 100")
        if source == "entity":
            return retrieval.hybrid_search(self.entities, query, kind=kind, capability=capability_, limit=top_k, **vectors)
        keys = ["callee_id", "caller_compound", "caller_sig"]
        rows = self.usages.withColumn("key", F.to_json(F.struct(*keys)))
        from quillgraph.functions import text

        hits = retrieval.keyword_channel(text.postings(rows, "key", {"description": 1.0}), "key", query.lower().split(), top_k * 5)
        scored = hits.join(rows, "key").select(*keys, "score")
        none = scored.limit(0).select(*keys, "score")
        best = retrieval.best_usages(retrieval.usage_scores(scored, none, keys), "callee_id", keys, top_k)
        out = best.join(self.entities.select(F.col("entity_id").alias("callee_id"), "kind", "capability"), "callee_id")
        for c, v in (("kind", kind), ("capability", capability_)):
            out = out.where(F.col(c) == v) if v else out
        return out

    def get_entity(self, entity_id: str, include_code: bool = False) -> DataFrame:
        """TL1, FN17: one row, or none and then a not_found status from status()."""
        code = F.col("source_text") if include_code else F.lit(None).cast("string").alias("source_text")
        shown = F.when(F.col("kind").isin("enum", "group"), F.col("source_text")).otherwise(code)
        return self.entities.where(F.col("entity_id") == entity_id).withColumn("source_text", shown)

    def status(self, rows: DataFrame, what: str) -> DataFrame:
        """TL8: one row status, what."""
        return rows.limit(1).agg(F.when(F.count("*") > 0, "ok").otherwise("not_found").alias("status")).withColumn("what", F.lit(what))

    def neighbors(self, entity_id: str, relationship: str | None = None, direction: str = "both", limit: int | None = None) -> DataFrame:
        rows = graph.dependencies(self.edges, entity_id, relationship, direction, limit)
        return rows.join(self.entities.select(*SUMMARY), rows["node"] == self.entities["entity_id"]).drop("node")

    def callers(self, entity_id: str, depth: int = 1, limit: int = 50) -> DataFrame:
        return self._levels(entity_id, depth, limit, True)

    def callees(self, entity_id: str, depth: int = 1, limit: int = 50) -> DataFrame:
        return self._levels(entity_id, depth, limit, False)

    def _levels(self, entity_id: str, depth: int, limit: int, reverse: bool) -> DataFrame:
        rows = graph.neighbours_by_depth(self.edges, entity_id, depth, limit, reverse)
        return rows.withColumnRenamed("node", "entity_id").join(self.entities.select(*SUMMARY), "entity_id")

    def source_code(self, entity_id: str, lines: DataFrame, context: int = 0) -> DataFrame:
        """TL2."""
        from quillgraph.sources.artifacts import slice_source

        e = self.entities.where(F.col("entity_id") == entity_id).select(
            "entity_id", F.col("file_path").alias("body_file"), F.col("body_start_line").alias("body_start"), F.col("body_end_line").alias("body_end")
        )
        return slice_source(e, lines, before=context, after=context)

    def explain_interface(self, entity_id: str) -> tuple[DataFrame, DataFrame]:
        """TL3: (signature, mechanism, contract, preconditions and calling metadata; the top five usages by caller)."""
        e = self.entities.where(F.col("entity_id") == entity_id)
        empty = scalars.blank_to_null
        row = e.select(
            "entity_id", "signature", F.concat_ws("\n", empty(F.col("brief")), empty(F.col("details"))).alias("mechanism"),
            empty(F.col("rationale")).alias("contract"), empty(F.col("notes")).alias("preconditions"), "returns", "params", "fan_in", "fan_out", "capability", "is_contract_seed",
        )
        return row, etl.top_callers(self.usages.where(F.col("callee_id") == entity_id), self.entities)

    def list_capabilities(self) -> DataFrame:
        return self.capabilities.orderBy("name")

    def capability_detail(self, name: str, functions: int = 10, entries: int = 20) -> dict[str, DataFrame]:
        """TL4, TL6, P8."""
        return {
            "capability": self.capabilities.where(F.col("name") == name),
            "dependencies": self.capability_edges.where((F.col("source_cap") == name) | (F.col("target_cap") == name)),
            "functions": self.entities.where((F.col("capability") == name) & (F.col("kind") == "function")).orderBy(F.desc("fan_in"), "entity_id").limit(functions).select(*SUMMARY),
            "entry_points": self.entry_points.where(F.array_contains("capabilities", name)).orderBy("name", "entity_id").limit(entries),
        }

    def compare_capabilities(self, names: list[str], limit: int = 50) -> DataFrame:
        calls = self.edges.where("relationship = 'calls'").select("src", "dst")
        return capability.compare(calls, self.entities.select(F.col("entity_id").alias("node"), "capability"), names, limit)

    def list_entry_points(self, pattern: str = "%", limit: int = 100) -> DataFrame:
        """TL5, P7."""
        return self.entities.where(F.col("is_entry_point") & F.col("name").like(pattern)).orderBy("name", "entity_id").limit(limit).select(*SUMMARY)

    def file_listing(self, path: str) -> DataFrame:
        """TL7."""
        return self.entities.where(F.col("file_path") == path).orderBy("body_start_line", "entity_id").select(*SUMMARY, "body_start_line")

    def behavior_slice(self, entity_id: str, max_depth: int = 5, max_size: int = 200):
        return graph.behavior_slice(self.edges, self.entities, entity_id, max_depth, max_size)

    def state_touches(self, entity_id: str) -> DataFrame:
        rows = graph.state_touches(self.edges, entity_id)
        return rows.join(self.entities.where("kind = 'variable'").select(F.col("entity_id").alias("node"), "name"), "node")

    def stats(self) -> DataFrame:
        return etl.statistics(self.entities, self.edges)
