"""Queries of catalogs, dictionary translation, commands and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill import resources as R
from glyphmill.functions.labels import label_code, label_sql
from glyphmill.operators import catalog, commands, dispatch, hooks, index, translate
from glyphmill.plans.lineage import scratch
from glyphmill.sources.store import stored_or_extracted
from glyphmill.sources.tables import table
from glyphmill.streaming import events as ev

MOMENT = "2025-07-01"
GAP = 3600


def _states(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The catalog before and after a moment: later documents are new, deleted ones go, reprocessed ones change."""
    d = table(spark, folder, "documents", "file_path", "file_hash", "doc_length", "status", "date_added", "deleted_at")
    moment = F.lit(MOMENT).cast("timestamp_ntz")
    before = d.filter(F.col("date_added") < moment).select("file_path", F.when(F.col("status") == "error", None).otherwise(F.col("file_hash")).alias("file_hash"), F.when(F.col("doc_length") > 100, 1).otherwise(2).alias("version"))
    after = d.filter("deleted_at is null").select("file_path", "file_hash", F.lit(2).alias("version"))
    return before, after


def catalog_diff(spark, folder):
    return catalog.diff(*_states(spark, folder), "file_path", "file_hash", "version")


def catalog_diff_counts(spark, folder):
    return catalog_diff(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def catalog_removed(spark, folder):
    return catalog.removed(*_states(spark, folder), "file_path")


def label_disambiguate(spark, folder):
    return catalog.disambiguate(table(spark, folder, "documents", "doc_id", "title"), "title", "doc_id")


def catalog_books(spark, folder):
    d = table(spark, folder, "documents", "source", "lang", "title", "n_chars")
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_chapters"), F.sum("n_chars").cast("bigint").alias("n_chars"), F.min("title").alias("first_title"))


def cache_valid(spark, folder):
    return catalog.valid_cache(R.CACHE.frame(spark), R.CACHE_NOW.frame(spark))


def translate_passthrough(spark, folder):
    """What a translation into English does with each document: passes it through, needs a model, or can't."""
    d = table(spark, folder, "documents", "doc_id", "text", "lang")
    return d.select("doc_id", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(label_code(F.col("lang")) == "en", "passthrough").when(label_code(F.col("lang")) == "ru", "model").otherwise("language_unknown").alias("outcome"))


def speech_rate(spark, folder):
    return table(spark, folder, "synthesis_request", "rate").filter("rate is not null").groupBy(F.col("rate").cast("bigint").alias("rate")).agg(F.count(F.lit(1)).alias("n")).withColumn("step", catalog.speech_rate(F.col("rate")).cast("bigint"))


def locale_codes(spark, folder):
    return R.LCIDS.frame(spark).select("code", catalog.english_locale(F.col("code")).alias("locale"))


def voice_catalog(spark, folder):
    v = R.VOICES.frame(spark).filter("voice_id <> '' and startswith(locale, 'en')").dropDuplicates(["voice_id"])
    w = W.orderBy(F.when(F.col("locale") == "en-US", 0).when(F.col("locale") == "en-GB", 1).otherwise(2), "name")
    return v.select("voice_id", "locale", "name", F.row_number().over(w).cast("bigint").alias("place"))


# --- dictionary and trees ---


def dictionary_parse(spark, folder):
    return translate.parse_lines(R.DICTIONARY_LINES.frame(spark), "line")


def dictionary_search(spark, folder):
    d = R.DICTIONARY.frame(spark)
    return d.filter(F.lower("source_word").contains("ar") | F.lower("target_word").contains("ар")).select("id", "source_word", "target_word")


def dictionary_upsert(spark, folder):
    return translate.upsert(R.DICTIONARY.frame(spark), R.DICTIONARY_CHANGES.frame(spark))


def dictionary_export(spark, folder):
    return R.DICTIONARY.frame(spark).select("id", F.concat_ws(" | ", "source_word", "target_word", "pos", "tag", "morph", "translation_source").alias("line"))


def _words(spark, folder) -> DataFrame:
    """Distinct rows of the tokens table with a universal part of speech."""
    t = table(spark, folder, "tokens", "id", "sentence_id", "token_index", "wordform", "lemma", "pos_rus").dropDuplicates(["id"])
    pos = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in R.TOKEN_POS.items() for x in kv]), F.col("pos_rus")), F.lit("X"))
    return t.select("id", "sentence_id", "token_index", "wordform", F.lower(F.trim("lemma")).alias("lemma"), pos.alias("pos"))


def _annotated(spark, folder) -> DataFrame:
    """The words of sentences as annotated tokens: numbered in their sentence, attached by rules."""
    w = _words(spark, folder).filter("sentence_id is not null and lemma <> ''")
    i = F.row_number().over(W.partitionBy("sentence_id").orderBy("token_index", "id")) - 1
    return translate.attached(w.select(F.col("sentence_id").alias("sent_id"), i.alias("i"), F.col("wordform").alias("text"), "lemma", "pos", F.lit("").alias("tag")))


def mt_lookup(spark, folder):
    found = translate.lookup(_words(spark, folder).filter("lemma <> ''"), R.DICTIONARY.frame(spark))
    return found.filter("target is not null").groupBy("lemma", "pos", "target").agg(F.count(F.lit(1)).alias("n"))


def _translated(spark, folder) -> DataFrame:
    return translate.translate_tokens(_annotated(spark, folder), R.DICTIONARY.frame(spark))


def mt_tokens(spark, folder):
    return _translated(spark, folder).select("sent_id", F.col("i").cast("bigint").alias("i"), "text", "state", "ru")


def mt_direct(spark, folder):
    return translate.direct(_translated(spark, folder))


def mt_coverage(spark, folder):
    return translate.coverage(_translated(spark, folder))


def mt_coverage_by_sentence(spark, folder):
    return translate.coverage(_translated(spark, folder), "sent_id")


def mt_unknown_words(spark, folder):
    return translate.unknown_words(_translated(spark, folder))


def mt_report_lines(spark, folder):
    return translate.report(_translated(spark, folder), R.POS_NAMES)


def lexical_stats(spark, folder):
    return translate.lexical_stats(_words(spark, folder).filter("lemma <> ''"), "lemma", "pos", "wordform", "id")


def lexical_top(spark, folder):
    return translate.most_common(lexical_stats(spark, folder), 50)


def tag_decode(spark, folder):
    """Part of speech and relation of each word by name."""
    return _annotated(spark, folder).select("sent_id", F.col("i").cast("bigint").alias("i"), translate.decoded(F.col("pos"), R.POS_NAMES, "неизвестно").alias("pos_name"), translate.decoded(F.col("dep"), R.DEP_NAMES, "неизвестно").alias("dep_name"))


def tag_names(spark, folder):
    """Penn tags by name, of the annotated sentences."""
    return R.TOKENS.frame(spark).select("sent_id", F.col("i").cast("bigint").alias("i"), translate.decoded(F.col("tag"), R.TAG_NAMES, "").alias("tag_name"))


def _linked(spark, folder) -> DataFrame:
    return translate.relink(_translated(spark, folder).filter("ru <> ''"), _annotated(spark, folder))


def tree_relink(spark, folder):
    return _linked(spark, folder).select("sent_id", F.col("i").cast("bigint").alias("i"), F.col("new_head").cast("bigint").alias("new_head"))


def mt_transfer(spark, folder):
    return translate.transfer(_translated(spark, folder), _linked(spark, folder))


def dep_to_constituency(spark, folder):
    return translate.to_constituency(_annotated(spark, folder))


def tree_shapes(spark, folder):
    return translate.tree_shape(dep_to_constituency(spark, folder))


# --- commands ---


def parse_command(spark, folder):
    return commands.parsed(R.COMMANDS.frame(spark), "text").select("id", "action", "argument", "target_language", "error_code")


def dispatch_counts(spark, folder):
    """Outcomes of the requests to read documents aloud, by what the document allows."""
    r = index.upsert_latest(table(spark, folder, "synthesis_request", "request_id", "doc_id", "text", "requested_at"), ["request_id"], "requested_at")
    d = table(spark, folder, "documents", "doc_id", "lang", "status").withColumn("there", F.lit(True))
    j = r.join(d, "doc_id", "left")
    code = F.when(F.col("there").isNull(), "document_not_found").when(F.col("status") != "processed", "document_not_ready").when(F.coalesce(~label_code(F.col("lang")).isin("en", "ru"), F.lit(True)), "language_unknown").when(F.coalesce(F.trim("text"), F.lit("")) == "", "document_text_unavailable").otherwise("ok")
    return j.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def dispatch_messages(spark, folder):
    """Outcomes of searches in single documents: each judgment as a message that names its query and document."""
    q = table(spark, folder, "evaluation_query", "id", "query_text").select(F.col("id").alias("query_id"), F.concat(F.lit("find "), F.regexp_replace("query_text", r"[^A-Za-z ]", "")).alias("text"))
    j = table(spark, folder, "evaluation_judgment", "id", "query_id", "doc_id").dropDuplicates(["id"]).join(commands.parsed(q, "text"), "query_id")
    docs = table(spark, folder, "documents", "doc_id", "status", "lang", "text", "deleted_at")
    return dispatch.outcome(j, docs).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def dictionary_delete(spark, folder):
    """The dictionary without the word bridge, each row with the number of rows that went."""
    left, n = index.delete_where(R.DICTIONARY.frame(spark), F.lower("source_word") == "bridge")
    return left.select("id", "source_word").crossJoin(F.broadcast(n))  # one row


def table_cleared(spark, folder):
    return index.delete_all(table(spark, folder, "terms", "id", "term_text"))


# --- events and streams ---


def _events(spark, folder) -> DataFrame:
    return table(spark, folder, "events")


def debounce_events(spark, folder):
    return ev.debounce(_events(spark, folder), "user_id", "ts", "event_id", GAP).select("event_id")


def _stream(spark, folder: str, name: str) -> DataFrame:
    """A table as a stream of files; a table that is one file is picked from its folder by name."""
    path = f"{folder}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    one_file = not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    read = spark.readStream.schema(spark.read.parquet(path).schema)
    return read.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one_file else read.parquet(path)


def stream_debounce(spark, folder):
    """The accepted events of a stream over the events."""
    out = scratch(spark, "debounced")
    through = ev.Debouncer(spark, f"{out}/rows", "user_id", "ts", "event_id", GAP)
    s = _stream(spark, folder, "events").select("user_id", "ts", "event_id")
    ev.run_stream(lambda: ev.polled(s.writeStream.foreachBatch(through.write).option("checkpointLocation", f"{out}/state"), None).start())
    return through.accepted().select("event_id")


def stream_index(spark, folder):
    """Term counts of an index kept by a stream of documents; a batch is written under its number, so a repeat replaces it."""
    out = scratch(spark, "index")

    def write(batch: DataFrame, number: int) -> None:
        toks = index.tokens(batch.filter(label_code(F.col("lang")) == "en"), "doc_id", "en", R.STOPWORDS["en"])
        index.postings(toks).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    s = _stream(spark, folder, "documents").select("doc_id", "text", "lang")
    ev.run_stream(lambda: ev.polled(s.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state"), None).start())
    return spark.read.parquet(f"{out}/rows").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cnt"))


def stream_reindex(spark, folder):
    """An index that follows events of files: all are created, those changed later are read again, deleted ones go."""
    out = scratch(spark, "reindex")
    d = table(spark, folder, "documents", "doc_id", "status", "deleted_at")
    created = d.select("doc_id", F.lit("created").alias("kind"), F.lit(0).alias("no"))
    later = d.filter("deleted_at is not null or status = 'pending'").select("doc_id", F.explode(F.array(F.struct(F.lit("modified").alias("kind"), F.lit(1).alias("no")), F.struct(F.when(F.col("deleted_at").isNotNull(), "deleted").otherwise("modified").alias("kind"), F.lit(2).alias("no")))).alias("x")).select("doc_id", "x.*")
    created.write.parquet(f"{out}/events/part=1")
    later.write.parquet(f"{out}/events/part=2")
    docs = table(spark, folder, "documents", "doc_id", "text", "lang").filter(label_code(F.col("lang")) == "en")

    def postings(ids: DataFrame) -> DataFrame:
        return index.postings(index.tokens(docs.join(ids, "doc_id", "left_semi"), "doc_id", "en", R.STOPWORDS["en"]))

    follower = ev.IndexStream(spark, f"{out}/index", postings)
    s = spark.readStream.schema("doc_id bigint, kind string, no int, part int").option("maxFilesPerTrigger", 4).parquet(f"{out}/events")
    ev.run_stream(lambda: ev.polled(s.writeStream.foreachBatch(follower.write).option("checkpointLocation", f"{out}/state"), None).start())
    return follower.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cnt"))


def reconcile_index(spark, folder):
    """An index of the catalog's earlier state, brought to the later one: new, changed and stale files are read, removed ones go."""
    before, after = _states(spark, folder)
    docs = table(spark, folder, "documents", "file_path", "text", "lang").filter(label_code(F.col("lang")) == "en")
    of = lambda files: index.postings(index.tokens(docs.join(files, "file_path", "left_semi"), "file_path", "en", R.STOPWORDS["en"])).withColumnRenamed("doc_id", "file_path")
    status = catalog.diff(before, after, "file_path", "file_hash", "version")
    todo = status.filter("status in ('new', 'changed', 'stale')").select("file_path")
    touched = status.filter("status <> 'unchanged'").select("file_path")
    now = index.replace_documents(of(before.select("file_path")), of(todo), touched, "file_path")
    return now.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cnt"))


def coalesced_events(spark, folder):
    return ev.coalesced(_events(spark, folder).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def stored_text(spark, folder):
    """Each document's stored text, else the one its sentences give in their order."""
    s = table(spark, folder, "sentences", "id", "doc_id", "sentence_index", "text").dropDuplicates(["id"]).filter("doc_id is not null and text is not null")
    extracted = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence_index", "id", "text"))).alias("s")).select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("joined"))
    return stored_or_extracted(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", extracted, "joined").select("doc_id", F.md5("text").alias("digest"))


def embedding_backfill(spark, folder):
    """Vectors of all documents: stored ones, and hashed ones for documents without."""
    docs, v = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "embeddings", "vec_id", "embedding")
    filled = hooks.backfill(docs, "doc_id", "text", v, "vec_id", "embedding")
    return filled.select("doc_id", "stored", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("square"))


def expand_moves(spark, folder):
    return ev.expand_moves(R.FILE_EVENTS.frame(spark))


def stable_files(spark, folder):
    return ev.stable(R.FILE_EVENTS.frame(spark))


def silence_runs(spark, folder):
    return ev.silence_runs(_events(spark, folder), "user_id", "ts", GAP).select(F.col("key").alias("user_id"), "n_events", "started", "ended")


def window_rms(spark, folder):
    return ev.window_rms(_events(spark, folder), "ts", "value")


def running_totals(spark, folder):
    day = _events(spark, folder).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # a row per day
    return day.select("day", F.sum("n").over(w).alias("n_so_far"), F.round(F.sum("value").over(w), 2).alias("value_so_far"))


def last_n_events(spark, folder):
    return ev.last_events(_events(spark, folder), "user_id", "ts", "event_id").select("user_id", "event_id")


_ALL = (catalog_diff, catalog_diff_counts, catalog_removed, label_disambiguate, catalog_books, cache_valid, translate_passthrough, speech_rate, locale_codes, voice_catalog, dictionary_parse, dictionary_search, dictionary_upsert, dictionary_export, mt_lookup, mt_tokens, mt_direct, mt_coverage, mt_coverage_by_sentence, mt_unknown_words, mt_report_lines, lexical_stats, lexical_top, tag_decode, tag_names, tree_relink, mt_transfer, dep_to_constituency, tree_shapes, parse_command, dispatch_counts, dispatch_messages, dictionary_delete, table_cleared, debounce_events, stream_debounce, stream_index, stream_reindex, reconcile_index, coalesced_events, stored_text, embedding_backfill, expand_moves, stable_files, silence_runs, window_rms, running_totals, last_n_events)
QUERIES = {q.__name__: q for q in _ALL}

_STATES = f"b as (select file_path, case when status = 'error' then null else file_hash end as file_hash, case when doc_length > 100 then 1 else 2 end as version from documents where date_added < timestamp '{MOMENT}'), a as (select file_path, file_hash, 2 as version from documents where deleted_at is null)"
_DIFF = f"with {_STATES}, d as (select coalesce(a.file_path, b.file_path) as file_path, case when b.file_path is null then 'new' when a.file_path is null then 'removed' when a.file_hash is distinct from b.file_hash then 'changed' when b.version < a.version then 'stale' else 'unchanged' end as status from b full join a on a.file_path = b.file_path)"
_POS_CASE = "case pos_rus when 'Существительное' then 'NOUN' when 'Определитель' then 'DET' when 'Глагол' then 'VERB' when 'Прилагательное' then 'ADJ' when 'Предлог' then 'ADP' when 'Число' then 'NUM' else 'X' end"
_WORDS = f"w as (select id, sentence_id, token_index, wordform, lower(trim(lemma)) as lemma, {_POS_CASE} as pos from (select distinct id, sentence_id, token_index, wordform, lemma, pos_rus from tokens))"
_ANNOTATED = f"""{_WORDS}, nw as (select sentence_id as sent_id, row_number() over (partition by sentence_id order by token_index, id) - 1 as i, wordform as text, lemma, pos, '' as tag from w where sentence_id is not null and lemma <> ''),
 rw as (select *, coalesce(min(case when pos = 'VERB' then i end) over (partition by sent_id), min(i) over (partition by sent_id)) as root, min(case when pos = 'NOUN' then i end) over (partition by sent_id order by i rows between 1 following and unbounded following) as noun from nw),
 al as materialized (select sent_id, i, text, lemma, pos, tag, case when i = root then 'ROOT' when pos in ('DET', 'ADJ', 'NUM', 'ADP') and noun is not null then case pos when 'DET' then 'det' when 'ADJ' then 'amod' when 'NUM' then 'nummod' else 'case' end when pos = 'NOUN' then case when i < root then 'nsubj' else 'obj' end when pos = 'VERB' then 'conj' else 'dep' end as dep,
  case when i <> root and pos in ('DET', 'ADJ', 'NUM', 'ADP') and noun is not null then noun else root end as head from rw)"""
_DICT = f"dict as (select * from {R.DICTIONARY.values()}), ex as (select source_word, pos, arg_min(target_word, id) as exact from dict group by all), an as (select source_word, arg_min(target_word, id) as first_target from dict group by all)"
_STATE = f"""{_ANNOTATED}, {_DICT}, tk as (select * from al where pos not in ('PUNCT', 'SPACE')),
 st as (select tk.*, case when tk.pos in {R.sql_list(R.SKIPPED_POS)} or (tk.pos = 'AUX' and tag <> 'MD') then 'skipped' when coalesce(exact, first_target) is not null then 'translated' else 'unknown' end as state, coalesce(exact, first_target) as target
 from tk left join ex on ex.source_word = lower(tk.lemma) and ex.pos = tk.pos left join an on an.source_word = lower(tk.lemma)), tr as (select *, case state when 'skipped' then '' when 'translated' then target else text end as ru from st)"""
_COVERAGE = "count(*) as total_words, count(*) filter (where state = 'translated') as translated_words, count(*) filter (where state = 'skipped') as skipped_words, count(*) filter (where state = 'unknown') as n_unknown, round(count(*) filter (where state = 'translated') / count(*) * 100, 1) as coverage"
_C = R.DICTIONARY_CHANGES.values()
SQL = {
    "catalog_diff": f"{_DIFF} select file_path, status from d",
    "catalog_diff_counts": f"{_DIFF} select status, count(*) as n from d group by status",
    "catalog_removed": f"with {_STATES} select distinct file_path from b where file_path not in (select file_path from a)",
    "label_disambiguate": "select doc_id, case when title is not null and count(*) over (partition by title) > 1 then title || ' [' || doc_id || ']' else title end as label from documents",
    "catalog_books": "select source, lang, count(*) as n_chapters, cast(sum(n_chars) as bigint) as n_chars, min(title) as first_title from documents group by source, lang",
    "cache_valid": f"select c.* from {R.CACHE.values()} c where exists (select 1 from {R.CACHE_NOW.values()} n where n.doc_id = c.doc_id and n.file_hash = c.file_hash and n.language = c.language)",
    "translate_passthrough": f"select doc_id, case when coalesce(trim(text), '') = '' then 'empty' when {label_sql('lang')} = 'en' then 'passthrough' when {label_sql('lang')} = 'ru' then 'model' else 'language_unknown' end as outcome from documents",
    "speech_rate": "select cast(rate as bigint) as rate, count(*) as n, greatest(-10, least(10, cast(round_even(10 * log2(1 + rate / 100), 0) as bigint))) as step from synthesis_request where rate is not null group by rate",
    "locale_codes": f"""with c as (select code, list_filter(list_transform(string_split(code, ';'), lambda x: try_cast('0x' || regexp_replace(trim(x), '^0[xX]', '') as bigint)), lambda n: n is not null and n % 1024 = 9)[1] as n from {R.LCIDS.values()})
 select code, case when n is null then null when n = 1033 then 'en-US' when n = 2057 then 'en-GB' when n = 3081 then 'en-AU' when n = 4105 then 'en-CA' when n = 5129 then 'en-NZ' when n = 6153 then 'en-IE' else 'en-001' end as locale from c""",
    "voice_catalog": f"select voice_id, locale, name, row_number() over (order by case locale when 'en-US' then 0 when 'en-GB' then 1 else 2 end, name) as place from (select distinct * from {R.VOICES.values()} where voice_id <> '' and locale like 'en%')",
    "dictionary_parse": f"with l as (select line_no, trim(line, ' \t') as t from {R.DICTIONARY_LINES.values()}), p as (select line_no, list_transform(string_split(t, case when contains(t, '\t') then '\t' when contains(t, '|') then '|' when contains(t, ';') then ';' else ',' end), lambda x: trim(x, ' \t')) as p from l where t <> '' and not starts_with(t, '#')) select line_no, p[1] as source_word, p[2] as target_word, coalesce(p[3], '') as pos, coalesce(p[4], '') as tag, coalesce(p[5], '') as morph from p where p[1] <> '' and coalesce(p[2], '') <> ''",
    "dictionary_search": f"select id, source_word, target_word from {R.DICTIONARY.values()} where source_word ilike '%ar%' or target_word ilike '%ар%'",
    "dictionary_upsert": f"select coalesce(n.source_word, o.source_word) as source_word, coalesce(n.pos, o.pos) as pos, coalesce(n.target_word, o.target_word) as target_word, coalesce(nullif(n.source_form, ''), o.source_form, '') as source_form, coalesce(nullif(n.tag, ''), o.tag, '') as tag, coalesce(nullif(n.morph, ''), o.morph, '') as morph, coalesce(n.translation_source, o.translation_source) as translation_source from {R.DICTIONARY.values()} o full join {_C} n on n.source_word = o.source_word and n.pos = o.pos",
    "dictionary_export": f"select id, concat_ws(' | ', source_word, target_word, pos, tag, morph, translation_source) as line from {R.DICTIONARY.values()}",
    "mt_lookup": f"with {_WORDS}, {_DICT} select lemma, pos, target, count(*) as n from (select w.lemma, w.pos, coalesce(exact, first_target) as target from w left join ex on ex.source_word = lemma and ex.pos = w.pos left join an on an.source_word = lemma where lemma <> '') where target is not null group by all",
    "mt_tokens": f"with {_STATE} select sent_id, cast(i as bigint) as i, text, state, ru from tr",
    "mt_direct": f"with {_STATE} select sent_id, coalesce(string_agg(ru, ' ' order by i) filter (where ru <> ''), '') as translation from tr group by sent_id",
    "mt_coverage": f"with {_STATE} select {_COVERAGE} from tr",
    "mt_coverage_by_sentence": f"with {_STATE} select sent_id, {_COVERAGE} from tr group by sent_id",
    "mt_unknown_words": f"with {_STATE} select text as word, count(*) as n from tr where state = 'unknown' group by text",
    "mt_report_lines": f"""with {_STATE}, tot as (select {_COVERAGE} from tr), ls as (select lower(lemma) as lemma, pos, count(*) as n, max(ru) filter (where state = 'translated') as target from tr group by lower(lemma), pos)
 select 'totals' as section, cast(k as bigint) as place, rpad(label, 33, ' ') || v as line from (select unnest([0, 1, 2, 3, 4]) as k, unnest(['Всего слов:', 'Переведено:', 'Пропущено:', 'Не найдено в словаре:', 'Покрытие, %:']) as label, unnest([cast(total_words as varchar), cast(translated_words as varchar), cast(skipped_words as varchar), cast(n_unknown as varchar), cast(coverage as varchar)]) as v from tot)
 union all select distinct 'unknown', 0, '    ' || text from tr where state = 'unknown'
 union all select 'frequency', -n, lpad(cast(n as varchar), 8, ' ') || ' | ' || rpad(lemma, 20, ' ') || ' | ' || rpad(coalesce(target, ''), 22, ' ') || ' | ' || rpad(pos, 7, ' ') from ls
 union all select 'grammar', -n, rpad(lemma, 20, ' ') || ' ' || rpad(ls.pos, 7, ' ') || ' ' || coalesce(pos_name, ls.pos) from ls left join {R.POS.values()} p on p.pos = ls.pos""",
    "lexical_stats": f"with {_WORDS} select lemma, pos, count(*) as n, arg_min(wordform, id) as form from w where lemma <> '' group by lemma, pos",
    "lexical_top": f"with {_WORDS} select lemma, pos, count(*) as n, arg_min(wordform, id) as form from w where lemma <> '' group by lemma, pos order by n desc, lemma, pos limit 50",
    "tag_decode": f"with {_ANNOTATED} select sent_id, cast(i as bigint) as i, coalesce(pos_name, al.pos) as pos_name, coalesce(dep_name, al.dep) as dep_name from al left join {R.POS.values()} p on p.pos = al.pos left join {R.DEPS.values()} d on d.dep = al.dep",
    "tag_names": f"select sent_id, cast(i as bigint) as i, coalesce(tag_name, t.tag) as tag_name from {R.TOKENS.values()} t left join {R.TAGS.values()} g on g.tag = t.tag",
    "tree_relink": f"""with recursive {_STATE}, kp as (select sent_id, i from tr where ru <> ''),
 up as (select al.sent_id, al.i, al.head as h, 0 as n from al join kp on kp.sent_id = al.sent_id and kp.i = al.i union all select up.sent_id, up.i, al.head, n + 1 from up join al on al.sent_id = up.sent_id and al.i = up.h where (up.sent_id, up.h) not in (select sent_id, i from kp) and al.head <> al.i)
 select sent_id, cast(i as bigint) as i, cast(case when (sent_id, arg_max(h, n)) in (select sent_id, i from kp) then arg_max(h, n) else i end as bigint) as new_head from up group by sent_id, i""",
    "dispatch_counts": f"with r as (select request_id, doc_id, text from synthesis_request qualify row_number() over (partition by request_id order by requested_at desc) = 1) select case when d.doc_id is null then 'document_not_found' when status <> 'processed' then 'document_not_ready' when coalesce({label_sql('lang')} not in ('en', 'ru'), true) then 'language_unknown' when coalesce(trim(r.text), '') = '' then 'document_text_unavailable' else 'ok' end as code, count(*) as n from r left join documents d on d.doc_id = r.doc_id group by 1",
    "debounce_events": f"with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as r from events where user_id is not null and ts is not null), a as (select user_id, event_id, ts, r from e where r = 1 union all select * from (select n.user_id, n.event_id, n.ts, n.r from a join e n on n.user_id = a.user_id and n.r > a.r and n.ts >= a.ts + interval {GAP} second qualify row_number() over (partition by n.user_id order by n.r) = 1)) select event_id from a",
    "stream_index": f"select term, count(*) as df, cast(sum(c) as bigint) as cnt from (select doc_id, term, count(*) as c from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents where {label_sql('lang')} = 'en' and text is not null) where length(term) > 1 and term not in {R.sql_list(R.STOPWORDS['en'])} group by doc_id, term) group by term",
    "expand_moves": f"select event_no, 0 as part, path, case kind when 'moved' then 'deleted' else kind end as kind from {R.FILE_EVENTS.values()} union all select event_no, 1, dest_path, 'created' from {R.FILE_EVENTS.values()} where kind = 'moved'",
    "stable_files": f"select event_no, path, coalesce(size = lag(size) over w and mtime = lag(mtime) over w, false) as stable from {R.FILE_EVENTS.values()} window w as (partition by path order by seen_at, event_no)",
    "silence_runs": f"with l as (select user_id, ts, case when ts < lag(ts) over w + interval {GAP} second then 0 else 1 end as starts from events where user_id is not null window w as (partition by user_id order by ts)), g as (select user_id, ts, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as g from l) select user_id, count(*) as n_events, min(ts) as started, max(ts) as ended from g group by user_id, g",
    "window_rms": "select time_bucket(interval 1 day, ts) as started, round(sqrt(avg(value * value)), 4) as rms, round(max(abs(value)), 4) as peak from events group by 1",
    "running_totals": "with d as (select strftime(ts, '%Y-%m-%d') as day, count(*) as n, sum(value) as v from events group by 1) select day, cast(sum(n) over (order by day) as bigint) as n_so_far, round(sum(v) over (order by day), 2) as value_so_far from d",
    "last_n_events": "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 8",
}
SQL["stream_debounce"] = SQL["debounce_events"]
_INDEX = f"select term, count(*) as df, cast(sum(c) as bigint) as cnt from (select doc_id, term, count(*) as c from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents where {label_sql('lang')} = 'en' and text is not null and deleted_at is null) where length(term) > 1 and term not in {R.sql_list(R.STOPWORDS['en'])} group by doc_id, term) group by term"
SQL |= {
    "dispatch_messages": f"""with q as (select id as query_id, trim(regexp_replace(query_text, '[^A-Za-z ]', '', 'g')) as t from evaluation_query), j as (select distinct id, query_id, doc_id from evaluation_judgment),
 m as (select j.*, t = '' or regexp_matches(' ' || t || ' ', '(?i) (and|then) +(please +)?(find|search|look +for|summari[sz]e|(make|create) +(a +)?summary|translate|read|speak|voice) ') as bad from j join q using (query_id))
 select case when bad then 'invalid_command' when d.doc_id is null or deleted_at is not null then 'document_not_found' when coalesce(status, '') <> 'processed' then 'document_not_ready' when coalesce({label_sql('lang')} not in ('en', 'ru'), true) then 'language_unknown' when coalesce(trim(text), '') = '' then 'document_text_unavailable' else 'ok' end as code, count(*) as n from m left join documents d on d.doc_id = m.doc_id group by 1""",
    "dictionary_delete": f"select id, source_word, (select count(*) from {R.DICTIONARY.values()} where lower(source_word) = 'bridge') as n_deleted from {R.DICTIONARY.values()} where lower(source_word) <> 'bridge'",
    "table_cleared": "select id, term_text from terms where false",
    "stream_reindex": _INDEX,
    "reconcile_index": _INDEX,
    "coalesced_events": "select user_id, event_id, event_type from events where user_id is not null qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "stored_text": "with j as (select doc_id, string_agg(text, ' ' order by sentence_index, id) as joined from (select distinct id, doc_id, sentence_index, text from sentences where doc_id is not null and text is not null) group by doc_id) select doc_id, md5(coalesce(text, joined)) as digest from documents left join j using (doc_id)",
    "embedding_backfill": """with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents where text is not null),
 v as (select doc_id, cast('0x' || substr(md5(w), 1, 6) as bigint) % 64 as p, sum(case when substr(md5(w), 7, 1) < '8' then 1.0 else -1.0 end) as x from w group by all),
 h as (select doc_id, sum(x * x) as q from v group by doc_id), e as (select vec_id, list_sum(list_transform(cast(embedding as double[]), lambda x: x * x)) as q from embeddings where embedding is not null)
 select d.doc_id, e.vec_id is not null as stored, round(cast(case when e.vec_id is not null then e.q when text is not null then coalesce(h.q, 0) end as double), 4) as square from documents d left join e on e.vec_id = d.doc_id left join h on h.doc_id = d.doc_id""",
}

# commands as one string in small letters with single blanks, as the fixture's arguments are
_VERB_ROWS = ", ".join(f"({k}, '{action}', '{phrase}')" for k, (action, phrases) in enumerate(commands.PHRASES.items()) for phrase in phrases)
_ANY_OF = lambda phrases: "(" + "|".join(sorted(phrases, key=len, reverse=True)) + ")"
_ALL_VERBS = _ANY_OF([p for phrases in commands.PHRASES.values() for p in phrases])
_PLAIN_WORD = "[\\p{L}\\p{N}\\p{M}_]"
SQL["parse_command"] = f"""with t as (select id, regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '\\s+', ' ', 'g'), '^(пожалуйста|please)[, ]+', '') as t from {R.COMMANDS.values()}),
 verbs as (select * from (values {_VERB_ROWS}) as v(place, action, phrase)),
 hit as (select id, action, trim(substr(t, length(phrase) + 1)) as rest from t join verbs on starts_with(t, phrase) and not regexp_matches(substr(t, length(phrase) + 1, 1), '{_PLAIN_WORD}') qualify row_number() over (partition by id order by place, length(phrase) desc) = 1),
 said as (select id, action, regexp_replace(rest, '^мне( |$)', '') as rest from hit),
 sought as (select id, ltrim(regexp_replace(rest, '^{_ANY_OF(commands.FILLERS)}( *: *| +|$)', ''), ': ') as q from said where action = 'search'),
 outside as (select id, q, regexp_replace(q, '(^| )("[^"]*"|''[^'']*''|«[^»]*»|“[^”]*”|„[^“]*“)', ' ', 'g') as o, regexp_extract(q, '^("[^"]*"|''[^'']*''|«[^»]*»|“[^”]*”|„[^“]*“)') as lead from sought),
 found as (select id, case when lead <> '' then trim(substr(lead, 2, length(lead) - 2)) else q end as argument, regexp_matches(o, '(^| )["''«“„]') or regexp_matches(o, '((^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(и|затем|потом|and|then) +|[;,.!?] *)((пожалуйста|please) +)?{_ALL_VERBS}([^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)')
   or (lead <> '' and not regexp_matches(substr(q, length(lead) + 1), '^[ .!?]*$')) or regexp_matches(case when lead <> '' then substr(lead, 2, length(lead) - 2) else q end, '^[ .!?]*$') as bad from outside),
 others as (select id, action, regexp_replace(trim(rtrim(rest, '.!?')), '^{_ANY_OF(commands.OBJECTS)}( |$)', '') as o from said where action <> 'search'),
 aimed as (select id, action, o, case regexp_extract(o, '^(на|to|into|in) (русский|английский|russian|english|ru|en)( язык)?$', 2) when 'русский' then 'ru' when 'russian' then 'ru' when 'ru' then 'ru' when 'английский' then 'en' when 'english' then 'en' when 'en' then 'en' end as target from others),
 done as (select id, 'search' as action, argument, null as target from found where not bad union all select id, action, '', case when action = 'translation' then target end from aimed where case when action = 'translation' then target is not null else o = '' end)
 select t.id, action, coalesce(argument, '') as argument, target as target_language, case when action is null then 'invalid_command' end as error_code from t left join done on done.id = t.id"""
