"""Registered queries of the corpus operators: thin views with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontamination, exact_dedup, jaccard_join, lexical_search, line_dedup, lm_scoring, merkle, spotsigs, token_counts, toxicity, url_filters
from .common import crc_bucket, lower_ascii, positions, stored, whole_text


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The share of toxicity from which a document counts as toxic.
TOXIC_FROM = 0.3


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op1_url_filters(spark, sf):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_filters.judge_urls(_table(spark, sf, "pages"), rules)


def op2_line_dedup(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_passages(docs)


def op3_jaccard_join(spark, sf):
    docs = _table(spark, sf, "documents")
    return jaccard_join.jaccard_components(docs, jaccard_join.Settings(words=4, percent=85))


def op4_token_counts(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), drop_text=True)


def op5_byte_bpe(spark, sf):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    encoded = byte_bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, drop_text=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    digests = encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "token_ids")
    return byte_bpe.bpe_decode(digests, path, drop_ids=True).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


#: A conversation of control strings, beside those of the table.
CONTROL_CONVERSATION = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def op6_chat_format(spark, sf):
    own = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(own)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", empty("role"), empty("text")))).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    # Single questions come as prompt and response, all others as a list of messages.
    single = (F.size("t") == 2) & (first["role"] == "user") & (second["role"] == "assistant")
    prompt = F.to_json(F.struct(first["text"].alias("prompt"), second["text"].alias("response")))
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    records = turns.select("conv_id", F.when(single, prompt).otherwise(messages).alias("record"))
    formatted = chat_format.format_turns(chat_format.canonical_turns(records))
    read = formatted.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_lm_scoring(spark, sf):
    docs = _table(spark, sf, "documents")
    return lm_scoring.score_texts(docs, crc_bucket("doc_id", 10) == 0, public_tokenizers.path("piece_bpe_32k.model"))


def op8_toxicity(spark, sf):
    docs, labels = _table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "labels")
    model = toxicity.fit(docs, labels.where(crc_bucket("doc_id", 4) != 2))
    held_out = (crc_bucket("doc_id", 4) == 2).alias("held_out")
    return toxicity.score(docs, model, drop_text=True).select(
        "doc_id", held_out, "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op9_exact_dedup(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    digest = F.sha2(lower_ascii(whole_text()).cast("binary"), 256)
    found = exact_dedup.exact_duplicates(docs.withColumn("text_sha256", digest), carry=("text_sha256",))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_decontamination(spark, sf):
    return decontamination.find_contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op11_lexical_search(spark, sf):
    return lexical_search.top_k(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), lexical_search.Settings(k=20))


#: The fields of a leaf, in order.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark, sf):
    docs = _table(spark, sf, "documents")
    # Rows whose unsigned crc32 of the decimal id is even lose the line feeds of their text.
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").isNotNull()
    changed = [F.when(tampered, F.regexp_replace("text", "\n", "")).otherwise(F.col("text")) if f == "text" else F.col(f) for f in LEAF_FIELDS]
    docs = docs.select(*LEAF_FIELDS, merkle.leaf_of(changed).alias("_tampered"))
    found = merkle.manifest(docs, LEAF_FIELDS, group="source", order="doc_id", arity=3, carry=("doc_id", "_tampered"), label="op12")
    folded = merkle.fold(F.col("_tampered"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op13_spot_signatures(spark, sf):
    settings = spotsigs.Settings()
    docs = _table(spark, sf, "documents").select("doc_id", whole_text().alias("text")).withColumn("_r", F.monotonically_increasing_id())
    anchors = spotsigs.common_words(docs, settings.anchors)
    # Places by ascending doc_id are found on a slim table; texts move only to meet their places.
    slim = docs.select(F.lit(0).alias("_c"), "_r", "doc_id", F.xxhash64("text").alias("_h"), F.length("text").cast("long").alias("n_chars"))
    placed = positions(slim, ["_c"], ["doc_id", "_h", "_r"], "op13-order")
    total = placed.count()
    # Each row cuts the last quarter of its text; the row before it (its taker) takes that many
    # characters of this one. Both joins are keyed by row, so rows keep their place after the
    # first and only the given prefixes move again. Either side reads the row and text of docs
    # and nothing else of it, so the texts are shuffled once for both.
    taker = placed.select(((F.col("pos") + 1) % total).alias("pos"), F.col("_r").alias("_taker"), F.floor(F.col("n_chars") / 4).cast("int").alias("_wanted"))
    placed = stored(placed.select("_r", "pos", "doc_id", "n_chars").join(taker, "pos"), "op13-places")
    rows = docs.select("_r", "text").join(placed, "_r").withColumn("sigs", spotsigs.signatures(F.col("text"), anchors, settings))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    current = rows.select("_r", "doc_id", "n_chars", "sigs", F.substring("text", 1, (F.col("n_chars") - cut).cast("int")).alias("kept"))
    following = rows.select(F.col("_taker").alias("_r"), F.substring("text", 1, F.col("_wanted")).alias("given"), F.col("sigs").alias("next_sigs"))
    both = current.join(following, "_r").withColumn("edited", F.concat("kept", "given"))
    both = both.withColumn("edited_sigs", spotsigs.signatures(F.col("edited"), anchors, settings))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint_text(F.col("sigs")).alias("fingerprint"), spotsigs.fingerprint_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_chat_format": op6_chat_format,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spot_signatures": op13_spot_signatures,
}

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical_search.TERM}')"

ORACLE_SQL = {
    "op11_lexical_search": f"""
        with rows as (select doc_id, row_number() over () as d, {_TERMS} as t from documents),
        counts as (select d, doc_id, term, count(*) as tf from (select d, doc_id, unnest(t) as term from rows) group by all),
        lens as (select d, sum(tf) as n from counts group by d),
        tot as (select count(*) as big_n, sum(n) as big_l from lens),
        dfs as (select term, count(*) as df from counts group by term),
        imp as (
          select c.d, c.doc_id, c.term,
            cast(floor(1000 * ln(cast(2 * big_n + 2 as double) / cast(2 * df + 1 as double))) as bigint)
              * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) as impact
          from counts c join dfs using (term) join lens using (d) cross join tot),
        items as (select item_id, qid, unnest(t) as term from (select item_id, row_number() over () as qid, {_TERMS} as t from benchmark)),
        scores as (select qid, item_id, d, doc_id, sum(impact) as score from items join imp using (term) group by all)
        select item_id, cast(rank as integer) as rank, cast(doc_id as bigint) as doc_id, cast(score as bigint) as score
        from (select *, row_number() over (partition by qid order by score desc, doc_id, d) as rank from scores where score > 0)
        where rank <= 20""",
    "op6_chat_format": """
        with rows as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        turns as (
          select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as lines,
            coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned,
            sum(24 + length(said) + 2 * (length(said) - length(replace(said, '<', ''))) + 2 * (length(said) - length(replace(said, '[', '')))
              + length(said) - length(replace(said, chr(92), ''))) as formatted_chars
          from (select *, role || text as said from rows) group by conv_id)
        select conv_id, n_turns, sha256(lines) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256,
          cast(formatted_chars as bigint) as formatted_chars from turns""",
    "op9_exact_dedup": f"""
        with rows as (select doc_id, sha256({_NORMAL}) as text_sha256 from documents)
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, text_sha256
        from rows window same as (partition by text_sha256)""",
}
