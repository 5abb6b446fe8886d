"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.llm import automaton, chat, decontam, exact, jaccard, langid, merkle, pack, ppm, refine, search, simhash, toxic
from granary.llm.registry import query, table


@query(
    "op9_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op9_exact_dedup(spark, sf_dir):
    """The table arrives in two batches of rising ids, the second of which meets the first in the index."""
    found = exact.dedup(table(spark, sf_dir, "documents"), exact.fresh_index(spark), batches=2)
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


_ESCAPES = " + ".join(
    ["length({0}) - length(replace({0}, '\\', ''))"]
    + [f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL]
)
_FRAME = len("<s>[ROLE]") + len("[/ROLE]") + len("</s>")
_INST = len("[INST]") + len("[/INST]")


@query(
    "op10_chat_format",
    f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    t AS (
      SELECT *, {_FRAME} + CASE WHEN role = 'assistant' THEN 0 ELSE {_INST} END + length(role) + length(text)
        + {_ESCAPES.format("role")} + {_ESCAPES.format("text")} AS chars FROM c)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(chars)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op10_chat_format(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.read_back(chat.formatted(talks.unionByName(probe))).drop("rewritten_at")


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SEED_SQL = " UNION ALL ".join(
    "SELECT {id}, i AS at, "
    + f"{m} AS mask, "
    + " || ' ' || ".join(f"w[i + {k + 1}]" for k, c in enumerate(mask) if c == "1")
    + " AS seed FROM {t}, unnest(range(len(w) - {s} + 1)) AS u(i)".replace("{s}", str(decontam.SPAN))
    for m, mask in enumerate(decontam.MASKS)
)


@query(
    "op6_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    sd AS ({_SEED_SQL.format(id="doc_id", t="d")}), sb AS ({_SEED_SQL.format(id="item_id", t="b")}),
    g AS (SELECT DISTINCT doc_id, item_id, sd.at - sb.at AS diagonal FROM sd JOIN sb USING (mask, seed)),
    e AS (
      SELECT doc_id, item_id, diagonal, j, (d.w[diagonal + j + 1] = b.w[j + 1])::INT AS same, len(b.w) AS n_item,
        least({decontam.WINDOW}, len(b.w)) AS width
      FROM g JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(len(b.w))) AS u(j)
      WHERE diagonal + j >= 0 AND diagonal + j < len(d.w)),
    r AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS s,
        min(j) OVER (PARTITION BY doc_id, item_id, diagonal) AS low FROM e),
    v AS (SELECT x.doc_id, x.item_id, x.diagonal, max(x.s - coalesce(y.s, 0)) AS best
      FROM r x LEFT JOIN r y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.diagonal = y.diagonal AND y.j = x.j - x.width
      WHERE x.j - x.low + 1 >= x.width GROUP BY ALL),
    z AS (SELECT doc_id, item_id, diagonal, any_value(n_item) AS n_item, any_value(width) AS width, count(*) AS n_aligned, sum(same) AS n_matched
      FROM e GROUP BY ALL),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, n_matched DESC, n_aligned DESC, diagonal) AS k
      FROM z JOIN v USING (doc_id, item_id, diagonal) WHERE best >= ceil(width * {decontam.AGREE}))
    SELECT doc_id, item_id, diagonal::INT AS doc_begin, n_item::INT AS n_item, n_aligned::INT AS n_aligned, n_matched::INT AS n_matched, best::INT AS best
    FROM q WHERE k = 1
    """,
)
def op6_decontaminate(spark, sf_dir):
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op2_substring_dedup",
    f"""
    WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
    p AS (SELECT doc_id, w, i, sha256(array_to_string(w[i + 1 : i + {automaton.WINDOW}], ' ')) AS k
          FROM d, unnest(range(len(w) - {automaton.WINDOW - 1})) AS u(i)),
    r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM p),
    x AS (SELECT d.doc_id, j, w[j + 1] AS word, coalesce(again, FALSE)::INT AS again
          FROM d CROSS JOIN unnest(range(len(w))) AS u(j) LEFT JOIN r ON r.doc_id = d.doc_id AND r.i = j),
    c AS (SELECT doc_id, j, word, max(again) OVER (PARTITION BY doc_id ORDER BY j ROWS {automaton.WINDOW - 1} PRECEDING) AS gone FROM x)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
      sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (gone = 0), '')) AS kept_sha256
    FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id, d.w
    """,
)
def op2_substring_dedup(spark, sf_dir):
    found = automaton.dedup_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    found = refine.dedup_bytes(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _fold(n: int):
    """The remainder that splits documents into those learned from and those held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(_fold(3) != 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxic.fit(docs.filter(_fold(5) != 0), table(spark, sf_dir, "labels").filter(_fold(5) != 0))
    found = toxic.with_scores(docs.select("doc_id", "text"), model, "score")
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_packing")
def op1_packing(spark, sf_dir):
    packing = pack.pack(table(spark, sf_dir, "documents"))
    cut = packing.pieces.select("piece_key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return cut.join(packing.plan, "piece_key").drop("piece_key")


@query(
    "op4_jaccard_join",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {jaccard.SHINGLE}], ' ') AS g
          FROM d, unnest(range(greatest(1, len(w) - {jaccard.SHINGLE - 1}))) AS u(i) WHERE len(w) > 0),
    z AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b, x.k AS ka, y.k AS kb FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b
          WHERE common >= {jaccard.THRESHOLD} * (x.n + y.n - common)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n_links, count(DISTINCT kb) FILTER (ka <> kb) AS n_texts FROM l GROUP BY a)
    SELECT d.doc_id, class_id, coalesce(min(d.doc_id) OVER (PARTITION BY z.k, z.k IS NULL, CASE WHEN z.k IS NULL THEN d.doc_id END), d.doc_id) AS copy_id,
      CASE WHEN z.k IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY z.k) END AS n_copies,
      coalesce(n_texts, 0) AS n_texts, coalesce(n_links, 0) AS n_links
    FROM d JOIN c ON c.a = d.doc_id LEFT JOIN z USING (doc_id) LEFT JOIN n ON n.a = d.doc_id
    """,
)
def op4_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_lm_score")
def op8_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ppm.scores(docs, ppm.train(docs.filter(_fold(5) != 1)))
    return found.select("doc_id", (_fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{search.UPPER}', '{search.LOWER}'), '{search.TERM}')"
)


@query(
    "op11_ranked_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS rk, doc_id, {_TERMS} AS t FROM documents),
    tf AS (SELECT rk, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM (SELECT rk, doc_id, unnest(t) AS term FROM d) GROUP BY rk, term),
    dn AS (SELECT rk, sum(tf)::BIGINT AS n FROM tf GROUP BY rk),
    tot AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM dn),
    w AS (SELECT term, floor(1000 * ln((2 * big_n::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w FROM tf, tot GROUP BY term, big_n),
    m AS (SELECT rk, 25 + (75 * n * big_n) // big_l AS m FROM dn, tot),
    q AS (SELECT item_id, term, count(*) AS qc FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT q.item_id, tf.rk, tf.doc_id, sum(qc * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rk) GROUP BY ALL),
    r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
          FROM s WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {search.TOP}
    """,
)
def op11_ranked_search(spark, sf_dir):
    """Every benchmark item as a query against all documents."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_simhash")
def op12_simhash(spark, sf_dir):
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def _tampered(docs):
    """Rows whose unsigned crc32 of the decimal doc_id 7 divides get n_chars + 1 (nulls stay)."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7) == 0
    return F.when(hit & F.col("n_chars").isNotNull(), F.col("n_chars") + 1).otherwise(F.col("n_chars"))


@query("op13_merkle_manifest")
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = merkle.manifest(docs)
    changed = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), _tampered(found), F.col("text"))
    folded = merkle.fold(changed, F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified")
    )
