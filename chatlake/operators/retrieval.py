"""Retrieval over memory tables, for batches of queries.

Similarity search scores every memory of the query's owner, as a join of blocks: queries and
memories of an owner are dealt into blocks of bounded bytes, each pair of blocks is one cell, and a
cell is scored in small tiles with a running top-k per query (numpy in a cogroup).  An owner with a
third of all rows becomes many cells; a cell emits at most k rows a query, and a ``row_number()`` per
query merges the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions import text as tx
from chatlake.operators.deal import cells, sized, staged
from chatlake.operators.substring import substring_join

# Retrieval defaults and prompt texts of the chat agent.
TOP_K = 6
RECENCY_WEIGHT = 0.15
DRILL_TOP, DRILL_SECOND, DRILL_FIRST, DRILL_FALLBACK = 3, 3, 2, 2
REUSE_THRESHOLD = 0.7
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
STANDARD_SYSTEM_MESSAGE = (
    "Today's date is {today_date}. You are a human being named {persona_name}. You are not an AI. "
    "Respond as yourself. You will first be given the topic of conversation, then any existing "
    "conversation history if there is any. Be sure to reply in the style of {persona_name}. Use the "
    "'<|msg|>' token to send mulitple messages at once if you wish. ")
EXAMPLE_SYSTEM_MESSAGE = (
    "Here is an example conversation between {persona_name} and another individual. This conversation "
    "is not relevant to the current conversation. Use this conversation to help aid you to emulate "
    "stylistically on how to communicate in your conversations. 'Me' is the user that you are "
    "imitating.\n\n [BEGIN EXAMPLE CONVERSATION]\n{examples}\n[END EXAMPLE CONVERSATION]")
MEMORY_SYSTEM_MESSAGE = (
    "Here are some of your relevant memories + facts about yourself that may help you respond "
    "authentically. Pay careful attention to the date of the memories, as events have occurred in the "
    "past, and you should make reference to them in the appropriate time manner. \n\n[BEGIN MEMORIES]\n"
    "{memory_text}\n[END MEMORIES]")
FINAL_SYSTEM_MESSAGE = "Now you may begin the conversation."

# Bytes of vectors (as doubles) in one block of queries and of memories.
QUERY_BLOCK_BYTES = 16 << 20
MEMORY_BLOCK_BYTES = 16 << 20
# Rows of a tile of scores, queries by memories.
TILE = (256, 4096)
# Scores of one product differ in the last bits with the tile's shape: candidates this near the cut are scored again, row by row.
ROUNDING = 1e-12


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, accumulated in double."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                           F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def recency_scores(memories: DataFrame, fmt: str = TS_FORMAT) -> DataFrame:
    """Min-max recency per owner over parsable ``ts_text``.

    Unparsable or missing text scores 0; a zero time range counts as 1 s.
    """
    t = F.unix_micros(F.try_to_timestamp(F.col("ts_text"), F.lit(fmt)))
    m = memories.withColumn("_t", t)
    rng = m.groupBy("owner_id").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    span = F.when(F.col("_hi") == F.col("_lo"), F.lit(1_000_000)).otherwise(F.col("_hi") - F.col("_lo"))
    return m.join(rng, "owner_id", "left").withColumn(
        "recency", F.coalesce((F.col("_t") - F.col("_lo")) / span, F.lit(0.0))).drop("_t", "_lo", "_hi")


HIT = "owner_id string, query_id long, mem_id long, score double, similarity double"


def _vectors(column):
    """Rows of an Arrow array column of equal lengths as doubles; null components are NaN."""
    import numpy as np

    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _few_copies(vectors, recency, k: int):
    """Which rows can be among the best ``k``: of equal rows the first ``k`` (rows come in memory order)."""
    import numpy as np

    both = np.ascontiguousarray(np.column_stack([vectors, recency]))
    _, same = np.unique(both.view(np.dtype((np.void, both.itemsize * both.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(same[order]) != 0))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return np.sort(order[rank < k])


def _best(query, score, mem, k: int):
    """Order of rows by query, falling score and memory, cut to ``k`` rows a query."""
    import numpy as np

    order = np.lexsort((mem, -score, query))
    begin = np.flatnonzero(np.append(True, np.diff(query[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def block_topk(queries, memories, mem_ids, recency, k: int, w: float):
    """(query row, memory id, score, similarity) of the best ``k`` memories of each query row.

    Works through tiles of ``TILE`` with a running top-k, so its memory does not depend on how many
    queries or memories there are.  A zero vector, or one with missing components, scores -inf.
    """
    import numpy as np

    order = np.argsort(mem_ids, kind="stable")
    order = order[_few_copies(memories[order], recency[order], k)]
    memories, mem_ids, recency = memories[order], mem_ids[order], recency[order]
    length, size = np.linalg.norm(queries, axis=1), np.linalg.norm(memories, axis=1)
    out = []
    for a in range(0, len(queries), TILE[0]):
        tile, tall = queries[a:a + TILE[0]], length[a:a + TILE[0]]
        floor = np.full(len(tile), -np.inf)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        for b in range(0, len(memories), TILE[1]):
            part, wide, extra = memories[b:b + TILE[1]], size[b:b + TILE[1]], recency[b:b + TILE[1]]
            norm = np.outer(tall, wide)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = (1.0 - w) * (tile @ part.T) / norm + w * extra
            score[~(norm > 0) | np.isnan(score)] = -np.inf
            take = min(k, len(part))
            cut = np.maximum(np.partition(score, len(part) - take, axis=1)[:, len(part) - take], floor)
            some = score >= cut[:, None] - ROUNDING
            low = np.isneginf(cut)  # fewer scores than k: what has none goes by memory order
            some[low] &= ~np.isneginf(score[low]) | (np.cumsum(np.isneginf(score[low]), axis=1) <= k)
            i, j = np.nonzero(some)
            with np.errstate(invalid="ignore", divide="ignore"):
                near = (tile[i] * part[j]).sum(axis=1) / (tall[i] * wide[j])
            near[np.isneginf(score[i, j])] = np.nan
            again = np.where(np.isnan(near), -np.inf, (1.0 - w) * near + w * extra[j])
            best = [np.concatenate(x) for x in zip(best, (i, mem_ids[b + j], again, near))]
            kept = _best(best[0], best[2], best[1], k)
            best = [x[kept] for x in best]
            full = np.flatnonzero(np.bincount(best[0], minlength=len(tile)) == k)
            worst = np.full(len(tile), np.inf)
            np.minimum.at(worst, best[0], best[2])
            floor[full] = worst[full]
        out.append([best[0] + a, *best[1:]])
    return [np.concatenate(x) for x in zip(*out)]


def similarity_topk(queries: DataFrame, memories: DataFrame, k: int = TOP_K,
                    recency_weight: float = 0.0, query_bytes: int = QUERY_BLOCK_BYTES,
                    memory_bytes: int = MEMORY_BLOCK_BYTES) -> DataFrame:
    """Top-k memories per query by ``(1-w)*cosine + w*recency``.

    ``queries``: ``(owner_id, query_id, q_embedding)``; ``memories``:
    ``(owner_id, mem_id, embedding[, recency])``.  Ties keep memory order
    (``mem_id``).  Rows without a vector are no candidates (keyword search
    finds them), and vectors of different lengths never meet.
    """
    import pyarrow as pa

    mem = memories if "recency" in memories.columns else memories.withColumn("recency", F.lit(0.0))
    mem = mem.filter(F.size("embedding") > 0).select(
        "owner_id", F.size("embedding").alias("width"), F.col("mem_id").cast("long").alias("mem_id"), "embedding",
        F.coalesce(F.col("recency").cast("double"), F.lit(0.0)).alias("recency"))
    q = queries.filter(F.size("q_embedding") > 0).select(
        "owner_id", F.size("q_embedding").alias("width"), F.col("query_id").cast("long").alias("query_id"), "q_embedding")

    on = ["owner_id", "width"]
    q, mem = cells(q, mem, on, "query_id", "mem_id", F.col("n") * F.col("width") * 8 / query_bytes, F.col("n") * F.col("width") * 8 / memory_bytes)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"owner_id": pa.array([], pa.string()), "query_id": pa.array([], pa.int64()), "mem_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64()), "similarity": pa.array([], pa.float64())})
        row, mid, total, near = block_topk(_vectors(left["q_embedding"]), _vectors(right["embedding"]), right["mem_id"].to_numpy(),
                                           right["recency"].to_numpy(), k, recency_weight)
        return pa.table({"owner_id": pa.array([left["owner_id"][0].as_py()] * len(row), pa.string()), "query_id": left["query_id"].to_numpy()[row],
                         "mem_id": mid, "score": total, "similarity": near})

    cell = [*on, "l_block", "r_block"]
    out = q.groupBy(*cell).cogroup(mem.groupBy(*cell)).applyInArrow(score, HIT)
    w = W.partitionBy("owner_id", "query_id").orderBy(F.col("score").desc(), "mem_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def flat_search(queries: DataFrame, memories: DataFrame, k: int = TOP_K,
                recency_weight: float = RECENCY_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """Recency-weighted top-k and the rendered ``[ts] attribute`` text.

    Returns ``(hits, texts)``; ``texts`` has one row per query.
    """
    mem = recency_scores(memories)
    hits = similarity_topk(queries, mem, k, recency_weight)
    hits = hits.join(memories.select("owner_id", "mem_id", "ts_text", "attribute"), ["owner_id", "mem_id"])
    line = F.concat(F.lit("["), F.coalesce(F.col("ts_text"), F.lit("")), F.lit("] "), F.col("attribute"),
                    F.lit("\n"))
    texts = hits.groupBy("owner_id", "query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))),
                                 lambda x: x["l"]), "").alias("memory_text"))
    return hits, texts


# Rows of (query, word) and of (memory, word) in one block.
QUERY_BLOCK_WORDS = 1 << 16
MEMORY_BLOCK_WORDS = 1 << 20


def word_topk(query_word, word_of_query, mem_word, word_of_mem, k: int):
    """(query, memory, matches) of the best ``k`` memories of each query; ties by the smaller memory.

    ``query_word`` and ``mem_word`` number the words; ``word_of_query`` and ``word_of_mem`` name the query
    and the memory of each.  One query at a time: the memories that its words list are counted.
    """
    import numpy as np

    mems, mem = np.unique(word_of_mem, return_inverse=True)
    order = np.argsort(mem_word, kind="stable")
    words, first = np.unique(mem_word[order], return_index=True)
    last, listed = np.append(first[1:], len(order)), mem[order]
    at = np.searchsorted(words, query_word)
    some = at < len(words)
    some[some] = words[at[some]] == query_word[some]
    at, asked = at[some], word_of_query[some]
    turn = np.argsort(asked, kind="stable")
    queries, begin = np.unique(asked[turn], return_index=True)
    out = []
    for query, own in zip(queries, np.split(at[turn], begin[1:])):
        found, n = np.unique(np.concatenate([listed[first[w]:last[w]] for w in own]), return_counts=True)
        best = np.lexsort((found, -n))[:k]
        out.append((np.full(len(best), query), mems[found[best]], n[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def keyword_search(queries: DataFrame, memories: DataFrame, k: int = TOP_K,
                   query_words: int = QUERY_BLOCK_WORDS, memory_words: int = MEMORY_BLOCK_WORDS) -> DataFrame:
    """Memories ranked by how many distinct query words occur in them.

    Query words are lower-cased ``split()`` words; a word counts when it is
    a substring of the lower-cased attribute.  Distinct words of an owner meet
    the attributes by a substring join; queries and found (memory, word) rows
    are then dealt into blocks as in the similarity search, and each cell
    counts and keeps the best ``k`` per query, so that no (query, memory) pair
    beyond these is written or shuffled (ties by ``mem_id``).
    """
    import numpy as np
    import pyarrow as pa

    qw = queries.select("owner_id", F.col("query_id").cast("long").alias("query_id"),
                        F.explode(F.array_distinct(tx.words(F.lower("q_text")))).alias("word"))
    qw = staged(qw.filter(F.col("word") != ""))
    mem = memories.select("owner_id", F.col("mem_id").cast("long").alias("mem_id"), F.lower("attribute").alias("_text"))
    found = staged(substring_join(mem, qw.select("owner_id", "word").distinct(), "_text", "word", on=["owner_id"])
                   .select("owner_id", "mem_id", "word").distinct())
    left, right = cells(qw, found, ["owner_id"], "query_id", "mem_id", F.col("n") / query_words, F.col("n") / memory_words)

    def count(asked: pa.Table, listed: pa.Table) -> pa.Table:
        both = pa.concat_arrays([*asked["word"].chunks, *listed["word"].chunks]).dictionary_encode().indices.to_numpy()
        n = asked.num_rows
        query, mid, matches = word_topk(both[:n], asked["query_id"].to_numpy(), both[n:], listed["mem_id"].to_numpy(), k) if n and listed.num_rows else [np.zeros(0, np.int64)] * 3
        owner = [asked["owner_id"][0].as_py()] * len(query) if n else []
        return pa.table({"owner_id": pa.array(owner, pa.string()), "query_id": query, "mem_id": mid, "matches": matches.astype(np.int64)})

    cell = ["owner_id", "l_block", "r_block"]
    out = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(count, "owner_id string, query_id long, mem_id long, matches long")
    w = W.partitionBy("owner_id", "query_id").orderBy(F.col("matches").desc(), "mem_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def drill_links(memories: DataFrame, upper: int, lower: int, k: int) -> DataFrame:
    """Query-independent kNN links from level ``upper`` to level ``lower``."""
    up = memories.filter(F.col("level") == upper).select(
        "owner_id", F.col("mem_id").alias("query_id"), F.col("embedding").alias("q_embedding"))
    low = memories.filter(F.col("level") == lower).select("owner_id", "mem_id", "embedding")
    return similarity_topk(up, low, k).select("owner_id", F.col("query_id").alias("parent_id"),
                                              F.col("mem_id").alias("child_id"), F.col("rank").alias("child_rank"))


def parse_selections(judgements: DataFrame, n: int = DRILL_TOP) -> DataFrame:
    """``(owner_id, query_id, rank)`` of the items that a judge's ``text`` accepts.

    Item i is accepted when the text holds ``i.`` and nowhere, in any case, "not relevant".
    """
    text = F.col("text")
    ranks = F.array(*[F.when(text.contains(f"{i}."), F.lit(i)) for i in range(1, n + 1)])
    return judgements.filter(~F.lower("text").contains("not relevant")).select(
        "owner_id", "query_id", F.explode(F.filter(ranks, lambda x: x.isNotNull())).alias("rank"))


def hierarchical_search(queries: DataFrame, memories: DataFrame, selections: DataFrame | None = None) -> DataFrame:
    """Top 3 level-3 memories, selected ones -> 3 level-2 each -> 2 level-1 each.

    ``selections`` (``owner_id, query_id, rank``) marks the expanded level-3
    hits (the user's judge, see :func:`parse_selections`); queries without any
    selection expand their first ``DRILL_FALLBACK``.  Links between levels do
    not depend on the query and are computed once.  Duplicates are kept, one
    row per path.
    """
    top = memories.filter(F.col("level") == 3).select("owner_id", "mem_id", "embedding")
    t3 = staged(similarity_topk(queries, top, DRILL_TOP).select("owner_id", "query_id", "mem_id", "rank"))
    if selections is None:
        chosen = t3.filter(F.col("rank") <= DRILL_FALLBACK)
    else:
        marked = t3.join(selections.select("owner_id", "query_id", "rank", F.lit(True).alias("_sel")).distinct(),
                         ["owner_id", "query_id", "rank"], "left")
        any_sel = F.count("_sel").over(W.partitionBy("owner_id", "query_id"))  # at most DRILL_TOP rows a query
        chosen = marked.withColumn("_n", any_sel).filter(
            F.col("_sel") | ((F.col("_n") == 0) & (F.col("rank") <= DRILL_FALLBACK))) \
            .select("owner_id", "query_id", "mem_id", "rank")
    l32 = drill_links(memories, 3, 2, DRILL_SECOND)
    l21 = drill_links(memories, 2, 1, DRILL_FIRST)
    lvl3 = t3.select("owner_id", "query_id", F.lit(3).alias("level"), F.col("rank").alias("r3"),
                     F.lit(0).alias("r2"), F.lit(0).alias("r1"), "mem_id")
    lvl2 = staged(chosen.withColumnRenamed("mem_id", "parent_id").join(l32, ["owner_id", "parent_id"]).select(
        "owner_id", "query_id", F.lit(2).alias("level"), F.col("rank").alias("r3"),
        F.col("child_rank").alias("r2"), F.lit(0).alias("r1"), F.col("child_id").alias("mem_id")))
    lvl1 = lvl2.drop("r1").withColumnRenamed("mem_id", "parent_id").join(l21, ["owner_id", "parent_id"]).select(
        "owner_id", "query_id", F.lit(1).alias("level"), "r3", "r2",
        F.col("child_rank").alias("r1"), F.col("child_id").alias("mem_id"))
    return lvl3.unionByName(lvl2).unionByName(lvl1)


def drill_text(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Per query the numbered lines ``i. [timestamp] attribute`` that go to the summary prompt.

    Lines are the level-3 hits, then level 2, then level 1, each in the order of their paths (at most
    3 + 9 + 18 lines a query).  A memory without a timestamp shows ``Unknown date``.
    """
    m = memories.select("owner_id", "mem_id", F.concat(F.lit("["), F.coalesce("ts_text", F.lit("Unknown date")), F.lit("] "),
                                                       F.coalesce("attribute", F.lit(""))).alias("line"))
    path = F.struct((-F.col("level")).alias("l"), "r3", "r2", "r1", "line")
    lines = F.array_sort(F.collect_list(path))
    return hits.join(m, ["owner_id", "mem_id"]).groupBy("owner_id", "query_id").agg(
        F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
        .alias("memory_text"), F.count("*").cast("int").alias("n_lines"))


SEQ_BUCKET = 1 << 16   # seq values per bucket in which a session's certain searches are counted


def fold_reuse(vectors, start, ref, threshold: float):
    """Which rows reuse the row searched last, and the vector searched last at the end.

    ``start`` marks the rows that are searched whatever came before; ``ref`` is the vector searched
    before the first row, or None.  Looks ahead from each searched row in growing steps.
    """
    import numpy as np

    reused, size = np.zeros(len(vectors), bool), np.linalg.norm(vectors, axis=1)
    at, step = 0, 8
    while at < len(vectors):
        if ref is None or not np.isfinite(ref).all():
            ref, at, step = vectors[at], at + 1, 8
            continue
        ahead = slice(at, at + step)
        with np.errstate(invalid="ignore", divide="ignore"):
            near = vectors[ahead] @ ref / (size[ahead] * np.linalg.norm(ref)) > threshold
        near &= ~start[ahead]
        run = int(near.argmin()) if not near.all() else len(near)
        reused[at:at + run] = True
        at += run
        if run == len(near):
            step = min(2 * step, 4096)
        else:
            ref, at, step = vectors[at], at + 1, 8
    return reused, ref


def reuse_gate(queries: DataFrame, threshold: float = REUSE_THRESHOLD, bucket: int = SEQ_BUCKET) -> DataFrame:
    """Which queries of a session reuse the previous retrieval.

    ``queries``: ``(owner_id, session_id, seq, q_embedding, verdict)``;
    ``verdict`` is the judge's yes/no.  A query reuses when its similarity
    to the last SEARCHED query exceeds ``threshold`` and the verdict is yes;
    a reuse leaves the reference query unchanged.

    A query without a yes, or without a vector, is searched whatever came
    before, so it cuts its session: the stretches between such queries are
    independent, and numbering them is a running count (inside seq buckets,
    with a small table that carries the counts on).  Each stretch is folded
    over its sorted rows, batch by batch, with one vector held.
    """
    import numpy as np
    import pyarrow as pa

    key = ["owner_id", "session_id"]
    whole = F.col("q_embedding").isNotNull() & ~F.exists("q_embedding", lambda v: v.isNull())
    q = queries.select(*key, F.col("seq").cast("long").alias("seq"), F.when(whole, F.col("q_embedding")).alias("q_embedding"),
                       (~F.coalesce("verdict", F.lit(False)) | ~whole).alias("_start"), F.floor(F.col("seq") / bucket).alias("_b"))
    own = W.partitionBy(*key, "_b").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    q = q.withColumn("_n", F.sum(F.col("_start").cast("long")).over(own))
    carry = q.groupBy(*key, "_b").agg(F.max("_n").alias("_in")) \
        .withColumn("_before", F.coalesce(F.sum("_in").over(W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    q = q.join(carry.drop("_in"), [*key, "_b"]).withColumn("_stretch", F.col("_before") + F.col("_n"))
    q = q.select(*key, "seq", "q_embedding", "_start", "_stretch").repartition(*key, "_stretch").sortWithinPartitions(*key, "_stretch", "seq")

    def fold(batches):
        last, ref = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            width = max([len(v) for v in table["q_embedding"].to_pylist() if v is not None], default=0)
            rows = [v if v is not None and len(v) == width else [np.nan] * width for v in table["q_embedding"].to_pylist()]
            vectors = np.array(rows, dtype=np.float64).reshape(len(rows), width)
            start = table["_start"].to_numpy()
            names = list(zip(*[table[c].to_pylist() for c in (*key, "_stretch")]))
            edge = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            reused = np.zeros(len(names), bool)
            for a, b in zip(edge, edge[1:]):
                if names[a] != last or ref is not None and len(ref) != width:
                    ref = None
                reused[a:b], ref = fold_reuse(vectors[a:b], start[a:b], ref, threshold)
                last = names[a]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(reused)], [*key, "seq", "reused"])

    kinds = {c: queries.schema[c].dataType.simpleString() for c in key}
    return q.mapInArrow(fold, f"owner_id {kinds['owner_id']}, session_id {kinds['session_id']}, seq long, reused boolean")


def query_window(messages: DataFrame, n: int = 3, suffix: str = "/n Me: ") -> DataFrame:
    """Query text = the last ``n`` user messages joined by a blank line.

    ``messages``: ``(owner_id, session_id, seq, role, content)``; one output
    row per user message.  The live-chat suffix is removed when present.
    """
    u = messages.filter(F.col("role") == "user").withColumn(
        "c", F.when(F.col("content").endswith(suffix),
                    F.expr(f"substring(content, 1, length(content) - {len(suffix)})")).otherwise(F.col("content")))
    w = W.partitionBy("owner_id", "session_id").orderBy("seq").rowsBetween(-(n - 1), 0)
    return u.select("owner_id", "session_id", "seq",
                    F.array_join(F.collect_list("c").over(w), "\n\n").alias("query_text"))


def assemble_prompt(persona_name: str, today_date: str, examples: DataFrame | None,
                    memories: DataFrame | None, keys: DataFrame) -> DataFrame:
    """Base + example + memories + closing, per query key.

    ``keys``: ``(owner_id, query_id)``; ``examples``: ``(owner_id, query_id,
    transcript)``; ``memories``: ``(owner_id, query_id, memory_text)``.
    """
    base = STANDARD_SYSTEM_MESSAGE.format(today_date=today_date, persona_name=persona_name)
    r = keys
    parts = [F.lit(base)]
    if examples is not None:
        r = r.join(examples.select("owner_id", "query_id", "transcript"), ["owner_id", "query_id"], "left")
        ex_pre, ex_post = EXAMPLE_SYSTEM_MESSAGE.format(persona_name=persona_name, examples="\0").split("\0")
        parts.append(F.concat(F.lit("\n\n" + ex_pre), F.coalesce("transcript", F.lit("None")), F.lit(ex_post)))
    if memories is not None:
        r = r.join(memories.select("owner_id", "query_id", "memory_text"), ["owner_id", "query_id"], "left")
        m_pre, m_post = MEMORY_SYSTEM_MESSAGE.format(persona_name=persona_name, memory_text="\0").split("\0")
        parts.append(F.concat(F.lit("\n\n" + m_pre), F.coalesce("memory_text", F.lit("")), F.lit(m_post)))
    parts.append(F.lit("\n\n" + FINAL_SYSTEM_MESSAGE))
    return r.select("owner_id", "query_id", F.concat(*parts).alias("system_message"))


def embedding_coverage(memories: DataFrame, cache: DataFrame) -> DataFrame:
    """Per owner, memories with / without a cached embedding and orphans."""
    m = memories.select("owner_id", "mem_id", F.lit(True).alias("_m"))
    c = cache.select("owner_id", "mem_id", F.lit(True).alias("_c"))
    j = m.join(c, ["owner_id", "mem_id"], "full")
    return j.groupBy("owner_id").agg(
        F.count_if(F.col("_m") & F.col("_c")).alias("embedded"),
        F.count_if(F.col("_m") & F.col("_c").isNull()).alias("missing"),
        F.count_if(F.col("_m").isNull()).alias("orphaned"))


def routed_search(queries: DataFrame, memories: DataFrame, k: int = TOP_K,
                  recency_weight: float = RECENCY_WEIGHT) -> DataFrame:
    """Search by vectors where every memory of the owner has one, by words elsewhere.

    ``queries``: ``(owner_id, query_id, q_text, q_embedding)``; ``memories`` with ``embedding`` null where
    the cache has none (see :func:`embedding_coverage`).  ``route`` says which search a hit is from.  A
    query without a vector goes by words too.
    """
    whole = sized(staged(memories.groupBy("owner_id").agg((F.count("embedding") == F.count("*")).alias("whole"))))
    asked = queries.join(whole, "owner_id").withColumn("_vector", F.col("whole") & F.col("q_embedding").isNotNull()).drop("whole")
    near, _ = flat_search(asked.filter("_vector"), memories.join(whole.filter("whole"), "owner_id", "left_semi"), k, recency_weight)
    by_words = keyword_search(asked.filter(~F.col("_vector")), memories, k)
    cols = ["owner_id", "query_id", "rank", "mem_id"]
    return near.select(*cols, F.lit("vectors").alias("route")).unionByName(by_words.select(*cols, F.lit("words").alias("route")))


def embed_missing(memories: DataFrame, cache: DataFrame, encoder, model: str) -> DataFrame:
    """Embed memories absent from the cache for ``model``.

    ``encoder`` maps the attribute column to ``array<float>`` (a pandas UDF
    supplied by the user); the result is appended to the cache table.
    """
    have = cache.filter(F.col("model") == model).select("owner_id", "mem_id")
    todo = memories.join(have, ["owner_id", "mem_id"], "left_anti")
    return todo.select("owner_id", "mem_id", F.lit(model).alias("model"),
                       encoder(F.col("attribute")).alias("embedding"))
