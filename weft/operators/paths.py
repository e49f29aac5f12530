"""Path rewriting with relations of known paths."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.paths import ROOT, base_name, rewrite_known_paths

TRIE_BYTES = 64 << 20


def rewrite_by_owner(texts: DataFrame, known: DataFrame, owner: str, text_col: str = "text", path_col: str = "path", order_col: str = "ord") -> DataFrame:
    """Texts with the known paths of their owner rewritten. ``known`` is (owner, path, ord), some paths an owner."""
    lists = known.where(F.col(path_col).isNotNull()).groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct(order_col, path_col))), lambda s: s[path_col]).alias("_known"))
    return texts.join(lists, owner, "left").withColumn(text_col, rewrite_known_paths(F.col(text_col), F.col("_known"))).drop("_known")


def rewrite_with_trie(texts: DataFrame, known: DataFrame, text_col: str = "text", path_col: str = "path", target_col: str | None = None) -> DataFrame:
    """Texts in which paths of one large relation are replaced, longest first, each everywhere before the next.

    ``known`` is (path[, target]); without a target the file in the container's root. All paths are one
    Aho-Corasick trie, so a text costs a scan for each different path that it holds, not one for each known path: the
    longest found is replaced and only what is shorter, or follows it in order, is looked for again, also in
    text just written. Of equal paths the smallest target counts; NULL and empty paths do not. The trie is sent
    to the tasks in parts of at most ``TRIE_BYTES`` of paths, longest paths first, which keeps the order.
    """
    root = F.concat(F.lit(f"{ROOT}/"), base_name(F.col(path_col)))
    pairs = known.where(F.coalesce(path_col, F.lit("")) != "").groupBy(F.col(path_col).alias("p")).agg(F.min(F.col(target_col) if target_col else root).alias("t"))
    size, longest = pairs.agg(F.sum(F.length("p") + F.length("t")), F.max(F.length("p"))).first()
    if not size:
        return texts
    kinds = texts.schema
    # Lengths where parts end: paths of one length stay together unless they alone are over the bound.
    per = pairs.groupBy(F.length("p").alias("n")).agg(F.sum(F.octet_length("p") + F.octet_length("t")).alias("b")).orderBy(F.desc("n")).collect()  # a row a length
    cuts, held = [longest], 0
    for r in per:
        if held and held + r.b > TRIE_BYTES:
            cuts.append(r.n)
            held = 0
        held += r.b
    for high, low in zip(cuts, [*cuts[1:], 0], strict=True):
        part = pairs.where((F.length("p") <= high) & (F.length("p") > low)).collect()
        texts = texts.mapInPandas(_replacer({r.p: r.t for r in part}, text_col), kinds)
    return texts


def _replacer(targets: dict[str, str], text_col: str):
    def run(batches):
        import ahocorasick

        trie = ahocorasick.Automaton()
        for p in targets:
            trie.add_word(p, p)
        trie.make_automaton()

        def rewrite(text: str | None) -> str | None:
            if not text:
                return text
            done, todo = None, [(-len(p), p) for p in {p for _, p in trie.iter(text)}]
            heapq.heapify(todo)
            while todo:
                key = heapq.heappop(todo)
                if done is not None and key <= done:
                    continue
                done = key
                text = text.replace(key[1], targets[key[1]])
                todo = [(-len(p), p) for p in {p for _, p in trie.iter(text)} if (-len(p), p) > key]
                heapq.heapify(todo)
            return text

        for batch in batches:
            yield batch.assign(**{text_col: pd.Series([rewrite(t) for t in batch[text_col]], index=batch.index, dtype=object)})

    return run


def remap_by_name(files: DataFrame, copied: DataFrame, path_col: str = "path", new_col: str = "new_path", order_col: str = "ord") -> DataFrame:
    """Files whose path follows the copied file of the same name, the last of several; others keep theirs.

    ``copied`` is (path, new_path, ord): where originals went. A NULL or empty new path changes nothing.
    """
    last = copied.groupBy(base_name(F.col(path_col)).alias("_name")).agg(F.max_by(new_col, order_col).alias("_new"))
    moved = files.withColumn("_name", base_name(F.col(path_col))).join(last, "_name", "left")
    return moved.withColumn(path_col, F.coalesce(F.nullif("_new", F.lit("")), F.col(path_col))).drop("_name", "_new")
