"""Jobs that compose the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..operators import cleaning, graph, mentions, segment
from ..sources.scratch import written


def text_to_mentions(docs: DataFrame, dictionary: DataFrame, cfg: C.TextConfig = C.TextConfig(), raw: bool = False) -> DataFrame:
    """Documents (doc, text) to numbered paragraphs with seasons and their mentions."""
    numbered = segment.number_paragraphs(segment.paragraph_lists(docs, cfg, raw))
    return mentions.link_mentions(numbered.select("id", "season", "context"), dictionary)


def clean_graph(mention_rows: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relations, rejects) of mentions (line_no, context, entities) and relations
    (source, target, type, season, row_no). Without any valid node there are no
    relations either."""
    nodes, node_rejects = cleaning.clean_nodes(mention_rows)
    nodes = written(nodes, "nodes")
    if nodes.isEmpty():
        relations = relations.limit(0)
    kept, relation_rejects = cleaning.clean_relations(relations, nodes)
    return nodes, kept, node_rejects.unionByName(relation_rejects, allowMissingColumns=True)


def build_graph(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, name, labels) and edges of clean nodes (name, label) and relations."""
    merged = written(graph.merge_nodes(nodes.filter(F.col("label") != "")), "graph-nodes")
    return graph.with_label_arrays(merged), graph.merge_edges(relations, merged)
