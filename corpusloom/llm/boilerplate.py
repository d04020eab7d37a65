"""Lines repeated across the documents of one source, found as templates of fixed-depth token trees.

All rows of a document lie in one block. Each block lists the documents of every line and files the lines that are in the
wanted share of its documents of the source in a tree: source, number of tokens and the first tokens lead to a leaf,
whose templates take in similar lines by turning differing tokens into wildcards. A line that is frequent over all blocks
must be frequent in at least one of them, so nothing is lost, and a tree stays small whatever the texts. What the blocks keep is added up by leaf; leaves that can't reach the
share and number wanted are dropped too. The few templates left are merged into one tree; a second pass counts the
lines that match it exactly, over all documents.

Lines are compared lower-cased, trimmed, with runs of blanks as one space and runs of digits as ``#``; those with fewer
than ``min_letters`` letters don't count. Defined results for odd input: rows with a null id, source or text count
for nothing; a document in several rows counts once; empty texts have no lines; an empty table has no templates.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.runtime import materialize

WILD = "\x00*"
#: First tokens of a line that lead to a leaf; share of equal tokens that a template must have.
DEPTH, LIKENESS = 3, 0.6
#: Documents, and characters, of a block of a partition; a document is never divided.
BLOCK, BLOCK_CHARS = 20_000, 50_000_000
#: Templates or lines that the driver and a broadcast hold; more are taken in groups of sources.
MOST_LINES = 200_000
_digits = re.compile(r"[0-9]+")


def normal_lines(content: str) -> list[str]:
    """The normal forms of all lines, blank ones included."""
    return [" ".join(line.split()) for line in _digits.sub("#", content.lower()).split("\n")]


def enough_letters(line: str, least: int) -> bool:
    return len(line) >= least and sum(map(str.isalpha, line)) >= least


class TemplateTree:
    """Templates of one or more partitions; a template is a tuple of tokens with wildcards."""

    def __init__(self) -> None:
        self.leaves: dict[tuple, list[list]] = defaultdict(list)  # leaf -> [[tokens, documents]]

    @staticmethod
    def leaf(source: str, tokens: list[str] | tuple[str, ...]) -> tuple:
        # tokens with digits vary and don't lead anywhere
        return (source, len(tokens), *(WILD if "#" in t else t for t in tokens[:DEPTH]))

    def file(self, source: str, line: str, documents: list[int]) -> list:
        """The template that takes the line in, made or generalised as needed, with the documents it covers."""
        tokens = line.split(" ")
        entries = self.leaves[self.leaf(source, tokens)]
        best, most = None, -1
        if len(tokens) > DEPTH:
            need = LIKENESS * len(tokens)
            for e in entries:
                same = sum(map(str.__eq__, e[0], tokens))
                if same > most and same >= need:
                    best, most = e, same
                    if same == len(tokens):
                        break
        if best is None:
            best = [tuple(tokens), set()]
            entries.append(best)
        elif best[0] != tuple(tokens):
            best[0] = tuple(a if a == b else WILD for a, b in zip(best[0], tokens))
        best[1].update(documents)
        return best


def _fits(template: tuple[str, ...], tokens: list[str]) -> bool:
    return all(a == b or a is WILD or a == WILD for a, b in zip(template, tokens))


def least_coverage(min_share: float, n: int) -> float:
    # a little less than the share, so that rounding drops nothing
    return min_share * n * (1 - 1e-9)


def local_templates(df: DataFrame, min_share: float, min_letters: int, block: int = BLOCK) -> DataFrame:
    """Templates of the lines that are in ``min_share`` or more of some block's documents of their source: ``(block, source, leaf,
    template, coverage, n)``, and a row with null leaf for each source of a block with the number ``n`` of its documents.
    """

    def frequent(name: int, lines: dict[str, dict[str, list[int]]], sizes: dict[str, int]) -> pa.RecordBatch:
        tree = TemplateTree()
        for source, own in lines.items():
            least = least_coverage(min_share, sizes[source])
            for line, documents in own.items():
                if len(documents) >= least and enough_letters(line, min_letters):
                    tree.file(source, line, documents)
        found = [(name, s, None, None, 0, n) for s, n in sizes.items()]
        for leaf, entries in tree.leaves.items():
            found += [(name, leaf[0], " ".join(map(str, leaf[1:])), " ".join(e[0]), len(e[1]), sizes[leaf[0]]) for e in entries]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 6, kinds)], names=["block", "source", "leaf", "template", "coverage", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        lines, sizes, n, chars, last, own = defaultdict(dict), defaultdict(int), 0, 0, None, set()
        for b in batches:
            for doc, source, text in zip(*(c.to_pylist() for c in b.columns)):
                if doc != last:
                    if n == block or chars >= BLOCK_CHARS:
                        yield frequent(name, lines, sizes)
                        name, lines, sizes, n, chars = name + 1, defaultdict(dict), defaultdict(int), 0, 0
                    last, own, n = doc, set(), n + 1
                if source not in own:
                    own.add(source)
                    sizes[source] += 1
                chars += len(text)
                known = lines[source]
                for line in set(normal_lines(text)):
                    documents = known.get(line)
                    if documents is None:
                        known[line] = [n]
                    elif documents[-1] != n:
                        documents.append(n)
        yield frequent(name, lines, sizes)

    # the rows of a document follow each other in one partition
    return df.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, "block long, source string, leaf string, template string, coverage long, n long")


def global_templates(found: DataFrame, min_share: float, min_docs: int) -> DataFrame:
    """``(source, template)`` of those ``local_templates`` that have a line which may be in enough documents over all blocks.

    A line has one leaf, and in a block that leaf's greatest coverage at most; where the block keeps no template of the leaf,
    fewer documents than its least coverage.
    """
    unseen = F.ceil(F.col("n") * min_share * (1 - 1e-9)) - 1
    sources = found.filter("leaf IS NULL").groupBy("source").agg(F.sum("n").alias("size"), F.sum(unseen).alias("unseen"))
    blocks = found.filter("leaf IS NOT NULL").groupBy("source", "leaf", "block").agg(F.max("coverage").alias("most"), F.max("n").alias("n"))
    leaves = blocks.groupBy("source", "leaf").agg(F.sum(F.col("most") - unseen).alias("more"))
    enough = leaves.join(sources, "source").filter((F.col("more") + F.col("unseen") >= F.col("size") * min_share * (1 - 1e-9)) & (F.col("more") + F.col("unseen") >= min_docs))
    return found.filter("leaf IS NOT NULL").select("source", "leaf", "template").distinct().join(enough.select("source", "leaf"), ["source", "leaf"], "left_semi").select("source", "template")


def merge_templates(templates: list[tuple[str, str]]) -> dict[tuple, list[tuple[str, ...]]]:
    """One tree from the templates of all partitions; those that some line could fit together are generalised."""
    leaves: dict[tuple, list[tuple[str, ...]]] = defaultdict(list)
    for source, text in sorted(set(templates)):
        tokens = tuple(text.split(" "))
        entries = leaves[TemplateTree.leaf(source, tokens)]
        for i, e in enumerate(entries):
            if sum(map(str.__eq__, e, tokens)) >= LIKENESS * len(tokens) and all(a == b or WILD in (a, b) for a, b in zip(e, tokens)):
                entries[i] = tuple(a if a == b else WILD for a, b in zip(e, tokens))
                break
        else:
            entries.append(tokens)
    return dict(leaves)


def matching_tree(leaves: dict[tuple, list[tuple[str, ...]]]) -> dict[tuple[str, int], dict[str, list[tuple[str, ...]]]]:
    """The merged tree as it is searched: source and number of tokens, then the first token or a wildcard."""
    tree: dict[tuple[str, int], dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for leaf, templates in leaves.items():
        for t in templates:
            tree[leaf[0], leaf[1]][WILD if "#" in t[0] else t[0]].append(t)
    return {k: dict(v) for k, v in tree.items()}


def in_tree(tree: dict, source: str, line: str) -> bool:
    tokens = line.split(" ")
    level = tree.get((source, len(tokens)))
    if level is None:
        return False
    return any(_fits(t, tokens) for first in (tokens[0], WILD) for t in level.get(first, ()))


def by_sources(df: DataFrame, lists: DataFrame, source: str, run: Callable[[DataFrame, list], DataFrame]) -> DataFrame:
    """The union of ``run`` over groups of sources of which ``lists`` has about ``MOST_LINES`` rows each; one group if it has fewer.
    Rows without a source are in the first group."""
    groups = max(1, -(-lists.count() // MOST_LINES))
    if groups == 1:
        return run(df, lists.collect())
    group = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.lit(groups)), F.lit(0))
    parts = [run(df.filter(F.when(F.col(source).isNull(), 0).otherwise(group(source)) == g), lists.filter(group("source") == g).collect()) for g in range(groups)]
    return functools.reduce(DataFrame.unionByName, parts)


def repeated_lines(df: DataFrame, min_share: float = 0.1, min_docs: int = 5, min_letters: int = 15, doc: str = "doc_id", source: str = "source", content: str = "content") -> DataFrame:
    """``(source, line_text, n_docs)`` of the lines in at least ``min_share`` of their source's documents and in at least
    ``min_docs`` of them."""
    rows = df.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(content).alias("content")).dropna()
    # what the blocks keep may be long where sources are small; only leaves that can reach the share come to the driver
    local = materialize(local_templates(rows, min_share, min_letters), "templates")
    found = materialize(global_templates(local, min_share, min_docs).distinct(), "found")

    def matches(rows: DataFrame, templates: list) -> DataFrame:
        tree = rows.sparkSession.sparkContext.broadcast(matching_tree(merge_templates([tuple(r) for r in templates])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                docs, sources, lines = [], [], []
                for d, s, text in zip(*(c.to_pylist() for c in b.columns)):
                    for line in set(normal_lines(text)):
                        if in_tree(tree.value, s, line) and enough_letters(line, min_letters):
                            docs.append(d)
                            sources.append(s)
                            lines.append(line)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (map(str, docs), sources, lines)], names=["doc", "source", "line_text"])

        return rows.mapInArrow(run, "doc string, source string, line_text string")

    hits = by_sources(rows, found, "source", matches)
    # distinct pairs first, then counts: both pre-aggregate, and a line of a hot source is spread over its documents
    counts = hits.distinct().groupBy("source", "line_text").agg(F.count(F.lit(1)).alias("n_docs"))
    sizes = rows.select("source", "doc").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_source"))
    return (
        counts.join(sizes, "source")
        .filter((F.col("n_docs") >= min_docs) & (F.col("n_docs") >= min_share * F.col("n_source")))
        .select("source", "line_text", "n_docs")
    )


def without_lines(df: DataFrame, lines: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """``df`` with ``clean_content``: each content without its source's repeated lines. Null contents stay null."""
    lists = materialize(lines.select("source", "line_text"), "lines")
    df = df.drop("clean_content")
    schema = StructType([*df.schema.fields, StructField("clean_content", StringType())])
    at, src = df.columns.index(content), df.columns.index(source)

    def cleaned(rows: DataFrame, own: list) -> DataFrame:
        found: dict[str, set[str]] = defaultdict(set)
        for r in own:
            found[r["source"]].add(r["line_text"])
        shared = rows.sparkSession.sparkContext.broadcast(dict(found))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for s, text in zip(b.column(src).to_pylist(), b.column(at).to_pylist()):
                    drop = shared.value.get(s)
                    if text and drop:
                        text = "\n".join(raw for raw, line in zip(text.split("\n"), normal_lines(text)) if line not in drop)
                    out.append(text)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "clean_content"])

        return rows.mapInArrow(run, schema)

    return by_sources(df, lists, source, cleaned)
