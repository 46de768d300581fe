"""The registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import align, ann, bpe, chat, exact_dedup, langid, mixing, near_dedup, repeats, sharding, token_files, toxicity, variants
from .storage import scratch_path, ship_package

#: Vocabulary files are parameters; the package of public tokenizers says where they are.
RANK_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(sql="""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


@register()
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabularies.path(RANK_FILE), vocabularies.PATTERN)


@register()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    file, pattern = vocabularies.path(TOKENIZER_FILE), vocabularies.PATTERN
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path,
                             lambda: token_files.text_encoder(file, pattern), end_id=0)
    return token_files.read_index(spark, path)


@register()
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    """The chain low quality -> toxic, fitted on the labelled documents of ``docs``."""
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity.fit_chain(docs, labels, ["low_quality", "toxic"])


@register()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_chain(spark, docs, sf_dir))
    return scored.withColumn("toxic", F.col("p_toxic") >= toxicity.Params().threshold)


@register()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@register()
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    said = "</s>[INST] ok [/INST]"
    trial = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trial)
    where = vocabularies.path(RANK_FILE), vocabularies.PATTERN
    return chat.read_back(chat.format_turns(turns, *where), *where)


@register(sql=f"""
    WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
    lv AS (SELECT d.*, level, key >> (60 - level) AS prefix FROM d, range(0, 60) AS r(level)),
    over AS (SELECT level, prefix FROM lv GROUP BY ALL HAVING sum(bytes) > {sharding.MAX_BYTES} AND count(*) > 1),
    leaf AS (SELECT lv.doc_id, lv.key, lv.bytes, count(over.level) AS depth
             FROM lv LEFT JOIN over ON lv.level = over.level AND lv.prefix = over.prefix GROUP BY ALL),
    s AS (SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(key >> (60 - depth)), depth::INT, '0') END
                 AS shard FROM leaf)
    SELECT doc_id, shard, bytes AS doc_bytes, sum(bytes) OVER (PARTITION BY shard)::BIGINT AS shard_bytes,
           count(*) OVER (PARTITION BY shard) AS shard_docs FROM s""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@register()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.prototypes(docs.where(~langid.held_out("doc_id")))
    return langid.predict(docs, *model)


@register()
def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@register(sql=r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
    p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS win FROM w),
    e AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM p),
    c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM e)
    SELECT d.doc_id, count(i) AS n_words, count(i) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.strip_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register(sql=r"""
    WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
    low AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
                   count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
    keyed AS (SELECT row_number() OVER () AS r, w, k, id || ':' || w AS s FROM low),
    spelled AS (SELECT r, flatten(list_transform(string_split(s, ''),
                  lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END)) AS b FROM keyed),
    placed AS (SELECT r, unnest(b) AS byte, unnest(range(0, len(b))) AS i, len(b) AS size FROM spelled),
    bit AS (SELECT range AS byte, range AS v, 0 AS j FROM range(256)
            UNION ALL SELECT byte, xor(v >> 1, 3988292384 * (v & 1)), j + 1 FROM bit WHERE j < 8),
    base AS (SELECT byte, v FROM bit WHERE j = 8),
    far AS (SELECT byte, v, 0 AS behind FROM base
            UNION ALL SELECT far.byte, xor(far.v >> 8, base.v), behind + 1 FROM far JOIN base ON base.byte = far.v & 255
            WHERE behind < (SELECT max(size) FROM placed)),
    crc AS (SELECT r, xor(bit_xor(far.v), 4294967295) AS h FROM placed
            JOIN far ON far.byte = xor(placed.byte, CASE WHEN i < 4 THEN 255 ELSE 0 END) AND far.behind = size - 1 - i GROUP BY r),
    v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word,
                 sum(k)::BIGINT AS n FROM crc JOIN keyed USING (r) GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
    cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v) z),
    near AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
             UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.rest = v.word
             UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.rest = v.word),
    best AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(near, (-n, near)) AS form FROM near GROUP BY word),
    judged AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN form END AS form,
                      CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
    chain AS (SELECT word, form AS root FROM judged WHERE form IS NOT NULL
              UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON c.root = j.word WHERE j.form IS NOT NULL),
    ends AS (SELECT c.word, c.root FROM chain c JOIN judged j ON c.root = j.word WHERE j.form IS NULL)
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM judged LEFT JOIN ends USING (word)""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.forms(variants.vocabulary(table(spark, sf_dir, "documents"), noise_every=97))


@register()
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    where = vocabularies.path(TOKENIZER_FILE), vocabularies.PATTERN, vocabularies.path(PIECE_FILE)
    return align.link_statistics(table(spark, sf_dir, "documents"), *where)
