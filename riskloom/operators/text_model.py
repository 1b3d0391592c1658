"""N-gram TF-IDF as relational Spark jobs.

* ``ngram_counts``: per-document 1..3-gram counts (the runs of each row's
  sorted n-grams; only rows that share an id are added up by a shuffle);
* ``term_stats`` / ``vocab_topk``: corpus tf and df per term, the
  ``VOCAB_SIZE`` most frequent terms (a bounded top-k), indexed in term
  order;
* ``vocabulary``: the same terms without a table of all n-grams, by a sketch
  that bounds every term's frequency and an exact count of the candidates;
* ``tfidf_vectors``: sublinear tf x smoothed idf, L2-normalised per doc.
  The vocabulary join is a broadcast of at most ``VOCAB_SIZE`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import NGRAM_MAX, VOCAB_SIZE
from ..functions.features import code_tokens, ngrams
from ..session import materialize

#: Cells of the sketch: what a map task sends at most, and a broadcast of at most 4 MB.
SKETCH_CELLS = 1 << 20
#: Column of a text's tokens.
TOKENS = "_tk"


def _runs(g: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> of a sorted array of terms: where its runs begin, and
    how long they are.  Linear, as the arrays are bound to lambda variables."""
    begins = F.filter(F.transform(g, lambda t, i: F.struct(t.alias("term"), i.alias("at"))),
                      lambda x: (x["at"] == 0) | (F.get(g, x["at"] - 1) != x["term"]))
    runs = F.transform(F.array(begins), lambda s: F.transform(s, lambda x, j: F.struct(
        x["term"].alias("term"), (F.coalesce(F.get(s, j + 1)["at"], F.size(g)) - x["at"]).cast("long").alias("tf"))))
    return F.get(runs, 0)


def tokenised(df: DataFrame, id_col: str, code_col: str = "code") -> DataFrame:
    """(id, TOKENS) of every row: read where a table of texts holds them (``model.text_table``),
    or made from the code."""
    return df.select(id_col, TOKENS) if TOKENS in df.columns else df.select(F.col(id_col), code_tokens(F.col(code_col)).alias(TOKENS))


def row_counts(df: DataFrame, id_col: str, code_col: str = "code", n_max: int = NGRAM_MAX) -> DataFrame:
    """(id, term, tf) of every row by itself: the n-grams are counted inside the
    row, so nothing is shuffled, held or spilled, however many there are."""
    toks = tokenised(df, id_col, code_col)
    counted = F.get(F.transform(F.array(F.sort_array(ngrams(F.col(TOKENS), n_max))), _runs), 0)
    return toks.select(F.col(id_col), F.explode_outer(counted).alias("_e")).where(F.col("_e").isNotNull()) \
        .select(id_col, F.col("_e.term").alias("term"), F.col("_e.tf").alias("tf"))


def ngram_counts(df: DataFrame, id_col: str, code_col: str = "code", n_max: int = NGRAM_MAX, unique: bool = False) -> DataFrame:
    """(id, term, tf) for every n-gram of the normalised code.

    Tokens are a column of their own first: the n-gram lambdas then read
    that column instead of re-running the tokenizer once per position
    (Catalyst does not share subexpressions into lambda bodies).  Where the caller
    knows ids to be ``unique``, the counts of the rows are the result."""
    counts = row_counts(df, id_col, code_col, n_max)
    return counts if unique else counts.groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))


def spread(df: DataFrame, id_col: str) -> DataFrame:
    """Rows dealt by id to the tasks of a shuffle: a file of one row group is read by
    one task, and what follows on its texts would stay there."""
    return df.repartition(id_col)


def _merged(lists: Column) -> Column:
    """The counts of rows that share an id, added up, by idx."""
    def runs(g: Column) -> Column:
        begins = F.filter(F.transform(g, lambda e, i: F.struct(e["idx"].alias("idx"), i.alias("at"))),
                          lambda x: (x["at"] == 0) | (F.get(g, x["at"] - 1)["idx"] != x["idx"]))
        return F.get(F.transform(F.array(begins), lambda s: F.transform(s, lambda x, j: F.struct(
            x["idx"].alias("idx"), F.aggregate(F.slice(g, x["at"] + 1, F.coalesce(F.get(s, j + 1)["at"], F.size(g)) - x["at"]),
                                               F.lit(0.0), lambda n, e: n + e["tf"]).alias("tf")))), 0)

    return F.get(F.transform(F.array(F.sort_array(F.flatten(lists))), runs), 0)


def vocab_counts(df: DataFrame, vocab: DataFrame, id_col: str, code_col: str = "code", n_max: int = NGRAM_MAX) -> DataFrame:
    """(id, counts ARRAY<STRUCT<idx, tf, idf>>) of the vocabulary's n-grams, sorted by
    idx; ids without any are left out.  Every row is counted by itself (Spark ML's
    ``CountVectorizerModel`` looks the terms up), so no row per n-gram is made or moved;
    the rows of an id are added up."""
    from pyspark.ml.feature import CountVectorizerModel

    terms = vocab.select("term", "idx", "idf").orderBy("idx").collect()  # at most VOCAB_SIZE rows
    if not terms:
        return df.select(id_col, F.array().cast("array<struct<idx:int,tf:double,idf:double>>").alias("counts")).where(F.lit(False))
    counter = CountVectorizerModel.from_vocabulary([r.term for r in terms], inputCol="_g", outputCol="_v")
    # a table of texts is dealt out as it is stored: only the counts move
    toks = tokenised(df if TOKENS in df.columns else spread(df.select(id_col, code_col), id_col), id_col, code_col)
    grams = toks.select(id_col, F.coalesce(ngrams(F.col(TOKENS), n_max), F.array().cast("array<string>")).alias("_g"))
    rows = counter.transform(grams).select(id_col, F.get(F.transform(F.array(F.unwrap_udt("_v")), lambda v: F.transform(
        v["indices"], lambda j, at: F.struct(j.alias("idx"), F.get(v["values"], at).alias("tf")))), 0).alias("_c"))
    lists = rows.groupBy(id_col).agg(F.collect_list("_c").alias("_l"))
    summed = lists.select(id_col, F.when(F.size("_l") == 1, F.get("_l", 0)).otherwise(_merged(F.col("_l"))).alias("_c"))
    # as text, which Spark takes whole instead of number by number
    idx, idf = (F.expr(f"array({', '.join(map(text, terms))})") for text in (lambda r: str(r.idx), lambda r: f"{r.idf!r}D"))
    return summed.where(F.size("_c") > 0).select(id_col, F.transform("_c", lambda e: F.struct(
        F.get(idx, e["idx"]).alias("idx"), e["tf"].alias("tf"), F.get(idf, e["idx"]).alias("idf"))).alias("counts"))


def term_stats(counts: DataFrame, id_col: str) -> DataFrame:
    """(term, tf, df): corpus frequency and document frequency."""
    return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(id_col).alias("df"))


def vocab_topk(stats: DataFrame, n_docs, k: int = VOCAB_SIZE) -> DataFrame:
    """The k most frequent terms (ties by term), with column index (term
    order) and smoothed idf = ln((1 + n) / (1 + df)) + 1."""
    top = stats.orderBy(F.col("tf").desc(), F.col("term").asc()).limit(k)
    idx = F.row_number().over(Window.orderBy("term")) - 1
    n = n_docs if not isinstance(n_docs, (int, float)) else F.lit(n_docs)
    return top.select("term", "tf", "df", idx.cast("int").alias("idx"),
                      (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def _hashed(terms: DataFrame, width: int) -> DataFrame:
    """``terms`` with the cell of each."""
    return terms.withColumn("cell", F.pmod(F.xxhash64("term"), F.lit(width)).cast("int"))


def _hashed_grams(df: DataFrame, id_col: str, code_col: str, width: int, n_max: int = NGRAM_MAX) -> DataFrame:
    """(id, term, cell) for every n-gram of the normalised code."""
    toks = tokenised(df, id_col, code_col)
    grams = toks.select(F.col(id_col), F.explode_outer(ngrams(F.col(TOKENS), n_max)).alias("term")).where(F.col("term").isNotNull())
    return _hashed(grams, width)


def vocabulary(df: DataFrame, n_docs, id_col: str, code_col: str = "code", k: int = VOCAB_SIZE,
               width: int = SKETCH_CELLS, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vocab, counts): what ``vocab_topk`` over all n-grams gives, and
    (id, term, tf, idx, idf) of its terms, both stored.

    The sketch adds the n-grams of all documents up in ``width`` cells, which a map
    task collapses to at most ``width`` numbers; a cell's sum is no smaller than the
    frequency of any term in it.  Terms of cells with at least ``least``
    occurrences are counted exactly.  If the k-th of these occurs ``least`` times or
    more, no term outside can be among the first k; otherwise its frequency is
    the next ``least``, which the second round cannot miss.  Where ids are ``unique``,
    candidates are counted inside their rows; otherwise the rows of an id are added up."""
    sketch = materialize(_hashed_grams(df, id_col, code_col, width).groupBy("cell").agg(F.count("*").alias("n")), "sketch")
    best = sketch.orderBy(F.desc("n"), "cell").limit(2 * k).agg(F.count("*"), F.min("n")).first()
    least = best[1] if best[0] == 2 * k else 1
    while True:
        # at most one row per cell
        heavy = F.broadcast(sketch.where(F.col("n") >= least).select("cell"))
        counts = _hashed(row_counts(df, id_col, code_col), width).join(heavy, "cell").select(id_col, "term", "tf")
        if not unique:
            counts = counts.groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))
        counts = materialize(counts, "candidates")
        vocab = materialize(vocab_topk(term_stats(counts, id_col), n_docs, k), "vocab")
        n, fewest = vocab.agg(F.count("*"), F.min("tf")).first()
        if least <= 1 or (n == k and fewest >= least):
            break
        least = fewest if n == k else 1
    return vocab, counts.join(F.broadcast(vocab.select("term", "idx", "idf")), "term")  # at most VOCAB_SIZE rows


def _with_idf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts with idx and idf: looked up in the vocabulary unless they hold them."""
    if "idx" in counts.columns:
        return counts
    return counts.join(F.broadcast(vocab.select("term", "idx", "idf")), "term")  # at most VOCAB_SIZE rows


def tfidf_long(counts: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, term, idx, weight): normalised sublinear tf-idf per doc/term."""
    w = _with_idf(counts, vocab).withColumn("w", (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", "idx", (F.col("w") / norm).alias("weight"))


def tfidf_sparse(counts: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, entries ARRAY<STRUCT<idx, weight>>) sorted by idx: one row per
    document, at most VOCAB_SIZE entries, L2 norm 1.  ``counts`` holds a row per
    document (``vocab_counts``) or per document and term."""
    def weight(tf: Column, idf: Column) -> Column:
        return ((F.lit(1.0) + F.log(tf)) * idf).alias("w")

    if "counts" in counts.columns:
        g = counts.select(id_col, F.transform("counts", lambda e: F.struct(e["idx"].alias("idx"), weight(e["tf"], e["idf"]))).alias("_e"))
    else:
        w = _with_idf(counts, vocab).select(id_col, "idx", weight(F.col("tf"), F.col("idf")))
        g = w.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("_e"))
    norm = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
    # the norm is bound to a lambda variable: inside the inner lambda it would be summed again for every entry
    entries = F.transform(F.array(norm), lambda n: F.transform("_e", lambda e: F.struct(
        e["idx"].alias("idx"), (e["w"] / n).alias("weight"))))
    return g.select(id_col, F.get(entries, 0).alias("entries"))
