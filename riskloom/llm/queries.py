"""The operators' queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, embedding_dedup, hard_negatives, html_text, language, language_model, merkle, packing, pii, quality, simhash, toxicity
from .common import in_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the held-out fifth are not learned from."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), in_fold("doc_id", 5, 0)
    model = quality.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the held-out quarter is not learned from."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), in_fold("doc_id", 4, 2)
    model = language.train(docs.where(~held))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@register
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document; the held-out seventh is not learned from."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), in_fold("doc_id", 7, 2)
    found = language_model.fit_and_score(docs, docs.where(~held))
    return found.select("doc_id", held.alias("held_out"), *found.columns[1:])


@register
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every window of 10 words of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_windows(docs, table(spark, sf_dir, "benchmark")).drop("text")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op4_decontamination"] = f"""
WITH items AS (SELECT DISTINCT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item, size, array_to_string(w[s: s + size - 1], ' ') AS pattern
             FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM sized)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
windows AS (SELECT doc_id, size, s, array_to_string(w[s: s + size - 1], ' ') AS pattern
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
                  FROM docs, (SELECT DISTINCT size FROM patterns) WHERE len(w) >= size)),
found AS (SELECT doc_id, s, windows.size, item FROM windows JOIN patterns USING (size, pattern)),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS spot FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)"""


@register
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors linked at a cosine of 0.95 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op5_embedding_near_dedup"] = """
WITH RECURSIVE sound AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings
            UNION SELECT reached.vec_id, links.b FROM reached JOIN links ON reached.other = links.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
many AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN many USING (vec_id)"""


@register
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents over 3-word shingles, linked at 2 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register
def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data and secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, count_name="n_replaced")


@register
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation, without quotes, in the order of replies."""
    return chat.formatted(chat.link(table(spark, sf_dir, "conversations")))


_PLAIN = r"regexp_replace(lower(part), '[^\p{L}\p{N}]', '', 'g')"
_INTRODUCED = (r"regexp_matches(line, '(?i)^[^\n]{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió|ha scritto)\b[^\n]{0,40}:\s*$')")
ORACLE["op10_chat_formatting"] = rf"""
WITH RECURSIVE msgs AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS rid, conv_id, turn, role, text FROM conversations),
lines AS (SELECT rid, i, l[i] AS line FROM (SELECT rid, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT rid, string_split(coalesce(text, ''), chr(10)) AS l FROM msgs))),
marked AS (SELECT rid, i, length(m) - length(replace(m, '>', '')) AS level, substr(line, length(m) + 1) AS line
           FROM (SELECT *, regexp_extract(line, '^[ \t]{{0,3}}(?:>[ \t]?)+') AS m FROM lines)),
grouped AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) AS run FROM
            (SELECT *, coalesce(level <> lag(level) OVER (PARTITION BY rid ORDER BY i), true) AS fresh FROM marked)),
quoting AS (SELECT rid, bool_or(level > 0) AS quotes, max(run) AS runs FROM grouped GROUP BY rid),
-- the last line with text of an own run that another run follows may introduce the quote
introducing AS (SELECT rid, i FROM (SELECT g.rid, g.i, g.line, row_number() OVER (PARTITION BY g.rid, g.run ORDER BY g.i DESC) AS back
                FROM grouped g JOIN quoting USING (rid) WHERE level = 0 AND run < runs AND trim(line, ' ' || chr(9) || chr(13)) <> '') WHERE back = 1 AND {_INTRODUCED}),
own AS (SELECT rid, string_agg(part, chr(10) ORDER BY run) AS text FROM
        (SELECT rid, run, trim(string_agg(line, chr(10) ORDER BY i), chr(10)) AS part
         FROM grouped WHERE level = 0 AND (rid, i) NOT IN (SELECT rid, i FROM introducing) GROUP BY rid, run)
        WHERE trim(part, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY rid),
clean AS (SELECT m.rid, m.conv_id, m.turn, m.role, CASE WHEN m.text IS NULL THEN NULL WHEN quotes THEN
          coalesce(trim(o.text, ' ' || chr(9) || chr(10) || chr(13)), '') ELSE m.text END AS text
          FROM msgs m JOIN quoting USING (rid) LEFT JOIN own o USING (rid)),
passages AS (SELECT rid, -1 AS passage, 0 AS level, coalesce(text, '') AS whole FROM clean UNION ALL
             SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY run) - 1, level, whole FROM
             (SELECT rid, run, level, string_agg(line, chr(10) ORDER BY i) AS whole FROM grouped WHERE level > 0 GROUP BY rid, run, level)
             WHERE trim(whole, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
parts AS (SELECT rid, passage, level, 0 AS rank, whole AS part FROM passages UNION ALL
          SELECT rid, passage, level, 1, unnest(regexp_split_to_array(whole, '\n[ \t]*\n')) FROM passages UNION ALL
          SELECT rid, passage, level, 2, unnest(string_split(whole, chr(10))) FROM passages UNION ALL
          SELECT rid, passage, level, 3, unnest(string_split(regexp_replace(paragraph, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)))
          FROM (SELECT rid, passage, level, unnest(regexp_split_to_array(whole, '\n[ \t]*\n')) AS paragraph FROM passages)),
units AS (SELECT u.rid, conv_id, turn, passage, level, plain, min(rank) AS rank FROM (SELECT *, {_PLAIN} AS plain FROM parts) u
          JOIN msgs USING (rid) WHERE length(plain) >= 8 GROUP BY u.rid, conv_id, turn, passage, level, plain),
found AS (SELECT q.rid, q.passage, q.level, s.turn AS original, row_number() OVER (PARTITION BY q.rid, q.passage ORDER BY q.rank, s.turn DESC) AS n
          FROM units q JOIN units s ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.plain = s.plain AND s.turn < q.turn
          WHERE q.level > 0 AND s.level = 0),
linked AS (SELECT rid, first(original ORDER BY level, passage) AS original, count(*) AS n_linked FROM found WHERE n = 1 GROUP BY rid),
replies AS (SELECT m.rid, m.conv_id, m.turn, l.original, coalesce(l.n_linked, 0) AS n_linked,
            coalesce(l.original, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS parent_turn FROM msgs m LEFT JOIN linked l USING (rid)),
climbed AS (SELECT rid, conv_id, turn AS at_turn, original AS up FROM replies UNION ALL
            SELECT c.rid, c.conv_id, r.turn, r.original FROM climbed c JOIN replies r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.turn = c.up),
threads AS (SELECT rid, at_turn AS thread_turn FROM climbed WHERE up IS NULL)
SELECT c.conv_id, c.turn, c.role, row_number() OVER (PARTITION BY c.conv_id ORDER BY thread_turn, c.turn) - 1 AS position, parent_turn, thread_turn,
       c.text, (SELECT count(*) FROM passages p WHERE p.rid = c.rid AND p.level > 0) AS n_quoted, n_linked,
       '<|' || coalesce(c.role, 'user') || '|>' || chr(10) || coalesce(c.text, '') || chr(10) || '<|end|>' || chr(10) AS formatted
FROM clean c JOIN replies USING (rid) JOIN threads USING (rid)"""


@register
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of the dataset's tree; one document in seven is tampered with after its proof is made."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    leaf, other = merkle.leaf_hash(*columns), merkle.leaf_hash(*columns[:3], more, columns[4])
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(in_fold("doc_id", 7, 0), other).otherwise(leaf).alias("shown"))
    found = merkle.manifest(rows)
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("levels")).alias("proof_sha256"),
                         merkle.folded(F.col("shown"), F.col("levels")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@register
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out third are not learned from."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), in_fold("doc_id", 3, 1)
    scored = toxicity.fit_and_score(docs, docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


_CRC32 = ("xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ascii(c)::UBIGINT)), "
          "lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), "
          "lambda a, x: xor(a >> 1, 3988292384::UBIGINT * (a & 1::UBIGINT)))), 4294967295::UBIGINT)")


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(cast(strlen(cast({c} AS varchar)) AS varchar) || ':' || cast({c} AS varchar), '-')"
                                   for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
    {_leaf_sql('(n_chars + 1)')} AS other, coalesce({_CRC32} % 7 = 0, false) AS tampered FROM documents),
placed AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS spot FROM leaves),
lower AS (SELECT tree, 0 AS level, spot, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
          UNION ALL SELECT tree, min(level) + 1, spot // 2, sha256(string_agg(digest, '' ORDER BY spot)), (min(n) + 1) // 2
          FROM lower WHERE n > 1 GROUP BY tree, spot // 2),
tops AS (SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place FROM lower WHERE n = 1),
upper AS (SELECT 0 AS level, place AS spot, subroot AS digest, count(*) OVER () AS n FROM tops
          UNION ALL SELECT min(level) + 1, spot // 2, sha256(string_agg(digest, '' ORDER BY spot)), (min(n) + 1) // 2
          FROM upper WHERE n > 1 GROUP BY spot // 2),
siblings AS (SELECT rid, s.level, (placed.spot >> s.level) % 2 AS odd, s.digest FROM placed JOIN tops USING (tree) JOIN lower s
             ON s.tree = placed.tree AND s.level < height AND s.spot = xor(placed.spot >> s.level, 1)
             UNION ALL SELECT rid, height + s.level, (place >> s.level) % 2, s.digest FROM placed JOIN tops USING (tree) JOIN upper s
             ON s.n > 1 AND s.spot = xor(place >> s.level, 1)),
tall AS (SELECT max(level) AS more FROM upper),
proofs AS (SELECT rid, string_agg(digest, '' ORDER BY level) AS all_siblings FROM siblings GROUP BY rid),
folds AS (SELECT rid, 0 AS level, height + more AS height, CASE WHEN tampered THEN other ELSE leaf END AS digest FROM placed JOIN tops USING (tree), tall
          UNION ALL SELECT f.rid, f.level + 1, f.height, sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN s.odd = 1 THEN s.digest || f.digest ELSE f.digest || s.digest END)
          FROM folds f LEFT JOIN siblings s ON s.rid = f.rid AND s.level = f.level WHERE f.level < f.height)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(all_siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM placed JOIN tops USING (tree) JOIN folds f ON f.rid = placed.rid AND f.level = f.height LEFT JOIN proofs ON proofs.rid = placed.rid,
     (SELECT digest AS root FROM upper WHERE n = 1)"""


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE["op11_hard_negatives"] = """
WITH sound AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
    AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT rid AS anchor, vec_id AS anchor_id, label AS anchor_label, v AS a FROM sound WHERE vec_id % 100 = 0),
scored AS (SELECT anchor, anchor_id, anchor_label, rid, vec_id, label, CAST(list_inner_product(a, v) AS BIGINT) AS score
           FROM anchors JOIN sound ON anchor <> rid AND len(a) = len(v)),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS n FROM scored WHERE label = anchor_label) WHERE n <= 5),
found AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id) AS rank,
          s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
          FROM positives p JOIN scored s ON s.anchor = p.anchor AND s.label <> p.anchor_label
          AND 100 * s.score >= 30 * p.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10"""
