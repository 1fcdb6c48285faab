"""Queries of audit events, cleaning, linkage, selection, disguise, models, sources and streams."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from textmill.functions import detect as D
from textmill.functions import normalize as N
from textmill.functions.fixed_values import DEPRECATED_KINDS, KINDS, LABELS, LINKAGE_CLOSING, LINKAGE_DEFAULT, LINKAGE_MECHANISMS, LINKAGE_NOTE
from textmill.operators import adversarial as G
from textmill.operators import audit_log as A
from textmill.operators import cleaning as C
from textmill.operators import linkage as J
from textmill.operators import models as M
from textmill.operators import features as X
from textmill.operators import selection as P
from textmill.operators.tables import place, stored
from textmill.plans.base import CLASSES, DOCS_SQL, EVENTS_SQL, PROBS_SQL, derived_events, labelled, number, probabilities, query, spread, sql_list, sql_number, table
from textmill.plans.text_queries import SCORE_SQL, rule_rows, turn_events
from textmill.sources import text_sources as S
from textmill.sources.event_log import EventLog
from textmill.streaming import cells as K
from textmill.streaming import streams as T
from textmill.streaming.cells import CellTable
from textmill.streaming.turns import keyed_state, turn_pairs_stream


# ---- audit events


def _redacted_sql():
    from textmill.plans.text_queries import TURNS_SQL

    hidden = lambda n: f"'[' || array_to_string(list_transform(range({n}), lambda x: '[\"[REDACTED]\"]'), ',') || ']'"
    return f"""{TURNS_SQL}, kn as (select key, count(*) as n from gf group by key), found_out as (select g.key, coalesce(n, 0) + (g_names <> '')::INT as n from g left join kn using (key)), found_in as (select key, detections as n from v),
rows as (select tt.*, i.n as in_n, o.n as out_n from tt join found_in i on i.key = tt.conv_id || '-' || tt.turn left join found_out o on o.key = tt.conv_id || '-' || tt.turn)
select conv_id, turn, 0 as seq, '[REDACTED]' as input, null::VARCHAR as raw_reply, null::VARCHAR as final_reply, {hidden('in_n')} as matches, in_action as action from rows
union all select conv_id, turn, 1, null, '[REDACTED]', null, {hidden('out_n')}, out_action from rows where not blocked and not down
union all select conv_id, turn, 2, null, null, case when not blocked and not down then '[REDACTED]' end, null, null from rows"""


@query("a1_redact", _redacted_sql())
def a1(spark, sf):
    df = A.redact(turn_events(spark, sf))
    return df.select("conv_id", "turn", "seq", "input", "raw_reply", "final_reply", F.to_json(F.transform("result.detections", lambda d: d["matches"])).alias("matches"), F.col("result.action").alias("action"))


@query("a2_event_results", f"with {EVENTS_SQL} select event_id, stage, action, risk_level, coalesce(case when n_found > 0 then category end, 'normal') as categories, n_found::BIGINT as detections, rule_hits::BIGINT as rule_hits, semantic_hits::BIGINT as semantic_hits from r")
def a2(spark, sf):
    r = A.event_results(derived_events(spark, sf), keep=("event_id",))
    return r.select("event_id", "stage", "action", "risk_level", F.array_join(F.array_distinct("categories"), "|").alias("categories"), "detections", "rule_hits", "semantic_hits")


STATS = """count(*) filter (score >= 80) as blocked, count(*) filter (action = 'sanitize') as rewritten, sum(rule_hits)::BIGINT as rule_hit_count, sum(semantic_hits)::BIGINT as semantic_hit_count,
count(*) filter (rule_hits > 0 and semantic_hits > 0) as joint_rule_semantic_hit_count, sum(case when stage = 'input' then n_found else 0 end)::BIGINT as input_detection_count, sum(case when stage = 'output' then n_found else 0 end)::BIGINT as output_detection_count"""


@query("a3_event_stats", f"with {EVENTS_SQL} select (select count(*) from e) as total_events, {STATS} from r")
def a3(spark, sf):
    return A.event_stats(derived_events(spark, sf))


@query("a3_event_stats_since", f"with {EVENTS_SQL} select (select count(*) from e where ts >= timestamp '2024-01-10') as total_events, {STATS} from r where ts >= timestamp '2024-01-10'")
def a3b(spark, sf):
    return A.event_stats(derived_events(spark, sf), F.lit("2024-01-10").cast("timestamp"))


LONG = """select 'stage' as dimension, stage as name from r union all select 'action', action from r union all select 'risk_level', risk_level from r union all select stage || '_action', action from r
union all select 'category', case when n_found > 0 then category else 'normal' end from r union all select 'category', category from r where n_found = 2 union all select 'category_detection', category from r where n_found > 0 union all select 'category_detection', category from r where n_found = 2
union all select 'stage', 'final' from e where stage = 'final' union all select 'final_action', action from e where stage = 'final'"""


@query("a4_counts_by", f"with {EVENTS_SQL}, l as ({LONG}) select dimension, name, count(*) as count from l group by all")
def a4(spark, sf):
    return A.counts_by(derived_events(spark, sf))


@query("a5_sources", f"with {EVENTS_SQL} select sum(rule_hits)::BIGINT as rule_hits, sum(semantic_hits)::BIGINT as semantic_hits from r")
def a5(spark, sf):
    d = derived_events(spark, sf).select(F.explode("result.detections").alias("d"))
    return d.agg(F.count_if(A.rule_source(F.col("d.source"))).alias("rule_hits"), F.count_if(A.semantic_source(F.col("d.source"))).alias("semantic_hits"))


@query("a6_stats_long", f"with {EVENTS_SQL}, l as ({LONG}) select dimension, name, count(*) as count from l where dimension in ('category', 'risk_level', 'action', 'stage') group by all")
def a6(spark, sf):
    return A.stats_long(derived_events(spark, sf))


@query("a7_dashboard_metrics", f"{SCORE_SQL} select count(*) as total, count(*) filter (score >= 40) as handled, count(*) filter (score >= 80) as blocked, count(*) filter (score >= 55) as output_blocked, count(*) filter (score between 40 and 60) as baseline_missed from s")
def a7(spark, sf):
    from textmill.functions.decide import action_of, risk_score

    df = rule_rows(spark, sf).select(risk_score(F.col("detections")).alias("score"))
    df = df.select(action_of(F.col("score")).alias("input_action"), F.when(F.col("score") >= 55, "block").otherwise("pass").alias("output_action"), F.col("score").between(40, 60).alias("baseline_missed"))
    return A.dashboard_metrics(df)


@query("a8_value_share", f"with {DOCS_SQL} select case when label = '' then 'unknown' else label end as value, count(*) as count, round(count(*) / (select count(*) from docs)::DOUBLE, 9) as share from docs group by 1")
def a8(spark, sf):
    return A.value_share(labelled(spark, sf), "label").withColumn("share", F.round("share", 9))


@query("a9_detection_lift", f"{SCORE_SQL} select greatest(count(*) filter (score >= 40) - count(*) filter (score >= 80), 0)::BIGINT as baseline, count(*) filter (score >= 40) as enhanced, count(*) filter (score >= 80) as recovered from s")
def a9(spark, sf):
    from textmill.functions.decide import risk_score

    df = rule_rows(spark, sf).select(risk_score(F.col("detections")).alias("score"))
    return A.detection_lift(df, F.col("score") >= 40, F.col("score") >= 80)


@query("a10_crosstab", "select lang, " + ", ".join(f"count(*) filter (source = 'src{i}') as src{i}" for i in range(4)) + " from documents group by lang")
def a10(spark, sf):
    return A.crosstab(table(spark, sf, "documents"), "lang", "source", [f"src{i}" for i in range(4)])


@query("a11_retention_filter", "select event_type, count(*) as events from events where ts >= timestamp '2024-01-20' - interval 7 day group by event_type")
def a11(spark, sf):
    return A.retention_filter(table(spark, sf, "events"), F.lit("2024-01-20").cast("timestamp"), 7, "ts").groupBy("event_type").agg(F.count("*").alias("events"))


@query("a11_expiring_log", "select event_type, count(*) as events, min(date_trunc('day', ts))::DATE::VARCHAR as first_day from events where ts >= timestamp '2024-01-20' - interval 7 day group by event_type")
def a11_log(spark, sf):
    """Events appended to a log of day partitions in two writes, the second of which drops the expired days, and read again."""
    log = EventLog(spark, place(spark, "log"), "time string, event_type string", 7)
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), "event_type", F.col("event_id") % 2 == 0).toDF("time", "event_type", "even")
    days = [dt.datetime(2024, 1, d, tzinfo=dt.UTC) for d in (10, 20)]
    log.append(e.where("even").drop("even"), days[0])
    log.append(e.where("not even").drop("even"), days[1])
    return log.read(now=days[1]).groupBy("event_type").agg(F.count("*").alias("events"), F.substring(F.min("time"), 1, 10).alias("first_day"))


@query("s7_pruned_log", "select event_type, count(*) as events from events where ts >= timestamp '2024-01-05 13:00:00' group by event_type")
def s7_log(spark, sf):
    log = EventLog(spark, place(spark, "log"), "time string, event_type string")
    log.append(table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), "event_type"))
    return log.read(F.lit("2024-01-05 13:00:00").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("events"))


# ---- cleaning

LABEL_ROWS = "rows as (select doc_id as row_number, text, case when doc_id % 17 = 0 then ' Normal ' when doc_id % 23 = 0 then 'odd' when doc_id % 29 = 0 then null when lang = 'en' and length(text) % 3 = 0 then 'ad' else label end as label from docs)"


def label_rows(spark, sf):
    i = F.col("doc_id")
    label = F.when(i % 17 == 0, " Normal ").when(i % 23 == 0, "odd").when(i % 29 == 0, None).when((F.col("lang") == "en") & (F.length("text") % 3 == 0), "ad").otherwise(F.col("label"))
    return labelled(spark, sf).select(i.alias("row_number"), "text", label.alias("label"))


PREPARED = f"with {DOCS_SQL}, {LABEL_ROWS}, p0 as (select row_number, coalesce(text, '') as text, lower(trim(coalesce(label, ''))) as label from rows), p as (select *, trim(text) = '' or label = '' as empty, not (trim(text) = '' or label = '') and label not in {tuple(LABELS)} as invalid from p0), g as (select text, count(*) as n, list_sort(list(distinct label)) as labels from p where not empty and not invalid group by text)"


@query("c1_clean_dataset", PREPARED + " select 'train_' || substr(sha256(text || chr(31) || labels[1] || chr(31) || 'source'), 1, 16) as sample_id, md5(text) as text, labels[1] as label, 'source' as source, 'v1' as data_version from g where len(labels) = 1")
def c1(spark, sf):
    return C.clean_dataset(label_rows(spark, sf)).withColumn("text", F.md5("text"))


@query("c2_conflict_queue", PREPARED + " select row_number, md5(text) as text, array_to_string(labels, '|') as labels, 'conflicting_labels' as reason from p join g using (text) where not empty and not invalid and len(labels) > 1 union all select row_number, md5(text), label, 'invalid_label' from p where invalid")
def c2(spark, sf):
    return C.conflict_queue(label_rows(spark, sf)).withColumn("text", F.md5("text"))


@query("c3_clean_summary", PREPARED + ", b as (select count(*) filter (len(labels) = 1) as output_rows, count(*) filter (len(labels) > 1) as conflict_groups, coalesce(sum(n - 1) filter (len(labels) = 1), 0)::BIGINT as duplicate_rows, coalesce(sum(n) filter (len(labels) > 1), 0)::BIGINT as conflict_rows from g), a as (select count(*) as input_rows, count(*) filter (empty) as empty_rows, count(*) filter (invalid) as invalid_rows from p) select *, conflict_rows + invalid_rows as review_rows from a, b")
def c3(spark, sf):
    return C.clean_summary(label_rows(spark, sf))


@query("c4_audit_issues", f"with {DOCS_SQL}, {LABEL_ROWS} select row_number, 'missing_text' as issue from rows where text is null union all select row_number, 'blank_text' from rows where trim(text) = '' union all select row_number, 'missing_label' from rows where trim(coalesce(label, '')) = '' union all select row_number, 'invalid_label' from rows where trim(coalesce(label, '')) <> '' and lower(trim(label)) not in {tuple(LABELS)}")
def c4(spark, sf):
    return C.audit_issues(label_rows(spark, sf))


@query("c5_duplicate_groups", "select md5(text) as text, count(*) as count, array_to_string(list_sort(list(distinct lang)), '|') as labels, array_to_string(list_sort(list(doc_id)), '|') as row_numbers from documents where text is not null group by text having count(*) > 1")
def c5(spark, sf):
    return C.duplicate_groups(table(spark, sf, "documents"), "text", "lang", "doc_id").withColumn("text", F.md5("text"))


@query("c5_duplicate_classes", "select md5(text) as text, count(*) as count, array_to_string(list_sort(list(distinct lang)), '|') as labels, min(doc_id) as first_row from documents where text is not null group by text having count(*) > 1")
def c5_classes(spark, sf):
    return C.duplicate_classes(table(spark, sf, "documents"), "text", "lang", "doc_id").withColumn("text", F.md5("text"))


@query("c5_duplicate_members", "select doc_id as row, min(doc_id) over (partition by text) as first_row, count(*) over (partition by text) as count from documents where text is not null qualify count(*) over (partition by text) > 1")
def c5_members(spark, sf):
    return C.duplicate_members(table(spark, sf, "documents"), "text", "doc_id")


@query("c6_conflicting_labels", "select md5(text) as text, count(*) as count, array_to_string(list_sort(list(distinct source)), '|') as labels from documents where text is not null group by text having count(distinct source) > 1")
def c6(spark, sf):
    return C.conflicting_labels(table(spark, sf, "documents"), "text", "source").withColumn("text", F.md5("text"))


@query("c6_trimmed_duplicates", "select count(*) as groups from (select 1 from documents group by regexp_replace(text, '^\\s+|\\s+$', '', 'g') having count(*) > 1)")
def c6b(spark, sf):
    return C.trimmed_duplicate_groups(table(spark, sf, "documents"))


@query("c7_label_distribution", f"with {DOCS_SQL}, d as (select unnest({sql_list(LABELS)}) as label), n as (select label, count(*) as n from docs where label in {tuple(LABELS)} group by label) select d.label, coalesce(n, 0) as count, round(coalesce(n, 0) / (select sum(n) from n)::DOUBLE, 6) as ratio from d left join n using (label)")
def c7(spark, sf):
    return C.label_distribution(labelled(spark, sf))


@query("c8_text_length_stats", "select min(length(text))::INT as min, max(length(text))::INT as max, round(avg(length(text)), 3) as mean, median(length(text))::DOUBLE as median, count(*) filter (length(text) < 2) as shorter_than_2, count(*) filter (length(text) > 500) as longer_than_500 from documents")
def c8(spark, sf):
    return C.text_length_stats(table(spark, sf, "documents"))


def normal_docs(spark, sf):
    return table(spark, sf, "documents").withColumn("normalized", F.lower(N.trim(F.col("text")))).select("doc_id", "text", "normalized", "lang", "source")


NORMAL = "n as (select doc_id, text, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as normalized, lang, source from documents), k as (select *, sha256(normalized) as group_id, count(distinct source) over (partition by normalized) as labels, row_number() over (partition by normalized order by doc_id) as rn, min(doc_id) over (partition by normalized) as kept_id from n)"


@query("c9_group_dedup", "with n as (select doc_id, text, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as normalized, lang from documents), g as (select normalized, count(distinct lang) as labels, min(doc_id) as kept from n group by normalized) select doc_id, sha256(normalized) as group_id, lang from n join g using (normalized) where labels = 1 and doc_id = kept")
def c9(spark, sf):
    return C.group_dedup(normal_docs(spark, sf), "normalized", "lang", ["doc_id"]).select("doc_id", "group_id", "lang")


@query("c10_duplicate_report", "with n as (select doc_id, text, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as normalized, lang from documents), g as (select normalized, count(distinct lang) as labels, min(doc_id) as kept, count(*) as c from n group by normalized) select sha256(normalized) as group_id, n.doc_id as dropped_id, kept as kept_id, case when n.text = k.text then 'exact' else 'normalized_equivalent' end as match_type from n join g using (normalized) join documents k on k.doc_id = kept where labels = 1 and c > 1 and n.doc_id <> kept")
def c10(spark, sf):
    return C.duplicate_report(normal_docs(spark, sf), "text", "normalized", "lang", ["doc_id"], "doc_id")


@query("c11_label_conflict_report", "select sha256(normalized) as group_id, array_to_string(list_sort(list(distinct source)), '|') as labels, count(*) as occurrence_count, '[\"' || array_to_string(list_sort(list(distinct lang)), '\",\"') || '\"]' as sources from (select lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as normalized, source, lang from documents) group by normalized having count(distinct source) > 1")
def c11(spark, sf):
    return C.label_conflict_report(normal_docs(spark, sf), "normalized", "source", "lang")


SPLIT_SQL = "case when source in ('src0', 'src1', 'src2') then 'test' when source = 'src3' then 'validation' else 'train' end"


def split_docs(spark, sf):
    split = F.when(F.col("source").isin("src0", "src1", "src2"), "test").when(F.col("source") == "src3", "validation").otherwise("train")
    return normal_docs(spark, sf).withColumn("split", split).withColumn("group_id", F.substring(F.sha2("normalized", 256), 1, 8))


@query("c12_cross_split_leakage", f"with n as (select text, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as normalized, lang, {SPLIT_SQL} as split from documents), k as (select 'exact' as match_type, sha256(text) as h, * from n union all select 'normalized', sha256(normalized), * from n) select match_type, h as match_sha256, array_to_string(list_sort(list(distinct split)), '|') as splits, array_to_string(list_sort(list(distinct lang)), '|') as labels, array_to_string(list_sort(list(distinct substr(sha256(normalized), 1, 8))), '|') as group_ids from k group by match_type, h having count(distinct split) > 1")
def c12(spark, sf):
    return C.cross_split_leakage(split_docs(spark, sf), {"exact": F.col("text"), "normalized": F.col("normalized")}, label="lang")


@query("c13_data_manifest", f"select lang as label, split, count(*) as count from (select lang, {SPLIT_SQL} as split from documents) group by cube (lang, split)")
def c13(spark, sf):
    return C.data_manifest(split_docs(spark, sf), "lang")


@query("c13_dedup_steps", "with g as (select lower(text) as k, count(*) as n, count(distinct text) as texts, count(distinct lang) as labels from documents group by 1) select sum(n)::BIGINT as rows, count(*) filter (labels > 1) as conflict_groups, coalesce(sum(n) filter (labels > 1), 0)::BIGINT as conflict_rows, coalesce(sum(n - texts) filter (labels <= 1), 0)::BIGINT as exact_duplicates, coalesce(sum(texts - 1) filter (labels <= 1), 0)::BIGINT as normalized_duplicates, count(*) filter (labels <= 1) as kept from g")
def c13b(spark, sf):
    return C.dedup_steps(table(spark, sf, "documents").withColumn("k", F.lower("text")), "k", "text", "lang")


@query("c15_fingerprint_of_ids", "with r as (select sha256(doc_id::varchar || chr(9) || coalesce(text, '')) as h from documents where doc_id % 2 = 0), q as (select substr(h, 1, 5) as bucket, sha256(array_to_string(list_sort(list(h)), chr(10))) as h, count(*) as n from r group by 1), p as (select substr(bucket, 1, 2) as bucket, sha256(array_to_string(list(h order by bucket), chr(10))) as h, sum(n) as n from q group by 1) select sha256(array_to_string(list(h order by bucket), chr(10))) as fingerprint, sum(n)::BIGINT as rows from p")
def c15b(spark, sf):
    """The frozen rows are those of even ids; all rows are read."""
    d = table(spark, sf, "documents")
    return C.content_fingerprint(d, "doc_id", "text", d.where("doc_id % 2 = 0").select("doc_id"))


def line_files(df, folders, order, value, path):
    """df's values as files of lines, one in each folder of the columns `folders`, in ascending order."""
    rows = df.select(*folders, order, F.col(value).alias("value")).repartition(*folders).sortWithinPartitions(*folders, order)
    rows.select(*folders, "value").write.partitionBy(*folders).text(path)


#: Files of lines: the texts of a thousand documents of a source.
FILES_SQL = "ld as (select doc_id, text, source, doc_id // 1000 as b from documents), lf as (select source, b, string_agg(text || chr(10), '' order by doc_id) as content from ld group by all)"


@query("c14_source_profile", f"with {FILES_SQL}, n as (select source, b, count(*) as lines, count(*) filter (trim(line) <> '') as nonblank_lines from (select source, b, unnest(string_split(text, chr(10))) as line from ld) group by all) select 'source=' || source || '/b=' || b as folder, strlen(content)::BIGINT as bytes, sha256(content) as sha256, lines, nonblank_lines from lf join n using (source, b)")
def c14(spark, sf):
    path = place(spark, "files")
    line_files(table(spark, sf, "documents").withColumn("b", F.expr("doc_id div 1000")), ["source", "b"], "doc_id", "text", path)
    return C.source_profile(spark, path, "*.txt").select(F.regexp_extract("path", "(source=[^/]*/b=[^/]*)/", 1).alias("folder"), "bytes", "sha256", "lines", "nonblank_lines")


@query("c15_content_fingerprint", "with r as (select doc_id::varchar as id, sha256(doc_id::varchar || chr(9) || coalesce(text, '')) as h from documents), q as (select substr(h, 1, 5) as bucket, sha256(array_to_string(list_sort(list(h)), chr(10))) as h, count(*) as n from r group by 1), p as (select substr(bucket, 1, 2) as bucket, sha256(array_to_string(list(h order by bucket), chr(10))) as h, sum(n) as n from q group by 1) select sha256(array_to_string(list(h order by bucket), chr(10))) as fingerprint, sum(n)::BIGINT as rows from p")
def c15(spark, sf):
    return C.content_fingerprint(table(spark, sf, "documents"), "doc_id", "text")


# ---- linkage



def keys():
    return {"exact": F.col("text"), "trimmed": N.trim(F.col("text")), "lower": F.lower(N.trim(F.col("text")))}


def sides(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), "source")
    return d.where(~F.col("source").isin("src1", "src2")), d.where(F.col("source").isin("src1", "src2"))


SIDES = "d as (select doc_id as id, text, lang as label, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents), kk as (select id, label, source, unnest([{'r': 0, 'm': 'exact', 'k': text}, {'r': 1, 'm': 'trimmed', 'k': t}, {'r': 2, 'm': 'lower', 'k': lower(t)}]) as k from d), tr as (select * from kk where source not in ('src1', 'src2')), ev as (select * from kk where source in ('src1', 'src2'))"
LEAK = f"with {SIDES}, f as (select k.m as m, k.k as k, min(id) as train_id, count(*) as train_rows from tr group by 1, 2), j as (select ev.id as eval_id, ev.k.r as r, ev.k.m as match_type, train_id, train_rows, row_number() over (partition by ev.id order by ev.k.r) as n from ev join f on f.m = ev.k.m and f.k = ev.k.k), best as (select * from j where n = 1)"


@query("j1_find_leakage", LEAK + " select eval_id, match_type, train_id, train_rows from best")
def j1(spark, sf):
    return J.find_leakage(*sides(spark, sf), keys()).select("eval_id", "match_type", "train_id", "train_rows")


@query("j2_internal_duplicates", f"with {SIDES}, f as (select k.m as m, k.k as k, min(id) as left_id from kk group by 1, 2), j as (select kk.id as right_id, left_id, kk.k.m as match_type, row_number() over (partition by kk.id order by kk.k.r) as n from kk join f on f.m = kk.k.m and f.k = kk.k.k where left_id <> kk.id) select left_id, right_id, match_type from j where n = 1")
def j2(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return J.internal_duplicates(d, keys())


@query("j3_leakage_by_set", LEAK + " select source as set_type, count(*) as leaks from best join d on d.id = eval_id group by source")
def j3(spark, sf):
    train, ev = sides(spark, sf)
    return J.leakage_by_set(J.find_leakage(train, ev, keys()), ev, "id", "source")


OVER = f"with {SIDES}, f as (select k.m as m, k.k as k, min(id) as reference_id, count(*) as refs, count(distinct label) as labels, min(label) as one from tr group by 1, 2), o as (select ev.k.m as match_type, ev.id as candidate_id, reference_id, refs as references, labels > 1 or one <> ev.label as label_conflict from ev join f on f.m = ev.k.m and f.k = ev.k.k)"


@query("j4_overlap", OVER + " select * from o")
def j4(spark, sf):
    train, ev = sides(spark, sf)
    return J.overlap(ev, train, keys()).select("match_type", "candidate_id", "reference_id", "references", "label_conflict")


INTERNAL = f"with {SIDES}, f as (select k.m as m, k.k as k, min(id) as left_id, count(distinct source) as labels from kk group by 1, 2), o as (select kk.k.m as match_type, left_id, kk.id as right_id, labels > 1 as label_conflict from kk join f on f.m = kk.k.m and f.k = kk.k.k where left_id <> kk.id)"


@query("j5_internal_overlap", INTERNAL + " select * from o")
def j5(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return J.internal_overlap(d, keys(), label_col="source")


@query("j6_label_conflicts", INTERNAL + " select match_type, count(*) as rows from o where label_conflict group by match_type")
def j6(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return J.label_conflicts(J.internal_overlap(d, keys(), label_col="source")).groupBy("match_type").agg(F.count("*").alias("rows"))


def gram_sets(spark, sf, name, key):
    df = spread(table(spark, sf, name).select(F.col(key).alias("id"), "text")).select("id", N.folded_dense(F.col("text")).alias("dense"))
    return df.select("id", N.char_ngrams(F.col("dense")).alias("members"))


GRAMS = "gs as (select 'b' as side, item_id as id, regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', '', 'g') as t from benchmark union all select 'd', doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', '', 'g') from documents), gr as (select side, id, list_distinct([substr(t, i::INT, 3) for i in range(1, length(t) - 1)]) as g from gs where length(t) >= 3), sim as (select a.id as left_id, b.id as right_id, len(list_intersect(a.g, b.g))::DOUBLE as i, len(a.g) as na, len(b.g) as nb from gr a join gr b on a.side = 'b' and b.side = 'd' and len(a.g) >= 0.4 * len(b.g) and len(b.g) >= 0.4 * len(a.g)), pairs as (select left_id, right_id, i / (na + nb - i) as similarity from sim where i / (na + nb - i) >= 0.4)"


@query("j7_nearest_reference", f"with {GRAMS}, n as (select *, row_number() over (partition by left_id order by similarity desc, right_id) as k from pairs) select left_id as candidate_id, right_id as reference_id, round(similarity, 6) as similarity from n where k = 1")
def j7(spark, sf):
    return J.nearest_reference(gram_sets(spark, sf, "benchmark", "item_id"), gram_sets(spark, sf, "documents", "doc_id"), 0.4)


@query("j8_similar_pairs", f"with {GRAMS} select left_id, right_id, round(similarity, 9) as similarity from pairs")
def j8(spark, sf):
    df = J.similar_pairs(gram_sets(spark, sf, "benchmark", "item_id"), gram_sets(spark, sf, "documents", "doc_id"), 0.4)
    return df.withColumn("similarity", F.round("similarity", 9))


@query("j9_jaccard", "select conv_id, turn, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0), 9) as similarity from (select conv_id, turn, list_distinct(string_split(lower(text), ' ')) as a, list_distinct(string_split(lower(lag(text, 1, '') over (partition by conv_id order by turn)), ' ')) as b from conversations)")
def j9(spark, sf):
    from pyspark.sql import Window

    before = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("a"), F.split(F.lower(before), " ").alias("b"))
    return df.select("conv_id", "turn", F.round(J.jaccard(F.array_distinct("a"), F.array_distinct("b")), 9).alias("similarity"))


@query("j10_overlap_by_source", f'''with {SIDES}, f as (select k.m as m, k.k as k, min(id) as reference_id from tr group by 1, 2), o as (select ev.k.m as match_type, s.source as source from ev join f on f.m = ev.k.m and f.k = ev.k.k join d s on s.id = reference_id) select match_type, case when source = 'src0' then 'old' when regexp_matches(source, '^src1') then 'teens' else 'other' end as source_kind, count(*) as "overlaps" from o group by all''')
def j10(spark, sf):
    train, ev = sides(spark, sf)
    return J.overlap_by_source(J.overlap(ev, train, keys()), [("old", "^src0$"), ("teens", "^src1")])


@query("j11_coverage_report", "select lang, source, count(*) as count from documents group by grouping sets ((lang), (source), (lang, source), ())")
def j11(spark, sf):
    return J.coverage_report(table(spark, sf, "documents"), ["lang", "source"], [["lang"], ["source"], ["lang", "source"], []])


@query("j11_overlap_gate", OVER + ''', b as (select count(*) as "overlaps", count(*) filter (label_conflict) as conflicts from o) select "overlaps", conflicts, (select count(*) from (select 1 from documents group by text having count(*) > 1)) as repeated_ids, false as passed from b''')
def j11b(spark, sf):
    train, ev = sides(spark, sf)
    found = J.overlap(ev, train, keys())
    return J.overlap_gate(found, J.label_conflicts(found), table(spark, sf, "documents"), "text")


STATUS = ["verified", "pending", "rejected"]


def reviews(spark, sf):
    d = table(spark, sf, "documents")
    pick = lambda at: F.get(F.array(*map(F.lit, STATUS)), F.pmod(number(F.col("doc_id"), at), F.lit(3)).cast("int"))
    first = d.select(F.col("doc_id").alias("sample_id"), pick(1).alias("review_status"), F.lit("r1").alias("reviewer"), F.col("lang").alias("notes"), "source")
    second = d.select((F.col("doc_id") + 7).alias("sample_id"), pick(5).alias("review_status"), F.when(F.pmod(number(F.col("doc_id"), 9), F.lit(5)) == 0, "").otherwise("r2").alias("reviewer"), F.col("source").alias("notes"))
    return first, second


REVIEWS = f"a as (select doc_id as sample_id, {sql_list(STATUS)}[({sql_number('doc_id', 1)} % 3) + 1] as s1, lang as n1, source from documents), b as (select doc_id + 7 as sample_id, {sql_list(STATUS)}[({sql_number('doc_id', 5)} % 3) + 1] as s2, source as n2, {sql_number('doc_id', 9)} % 5 = 0 as blank from documents), j as (select * from a join b using (sample_id))"


@query("j12_review_agreement", f"with {REVIEWS}, x as (select count(*) as reviewed, count(*) filter (s1 = s2) as agreed from j) select reviewed, agreed, (select count(*) from b where sample_id not in (select sample_id from a)) as unknown_ids, (select count(*) from b where s2 = 'pending') as pending, (select count(*) from b where blank) as without_reviewer, round(agreed / reviewed::DOUBLE, 6) as rate from x")
def j12(spark, sf):
    return J.review_agreement(*reviews(spark, sf))


@query("j13_review_disagreements", f"with {REVIEWS} select sample_id, source, n1 as lang, s1 as first_status, n1 as first_notes, s2 as second_status, n2 as second_notes from j where s1 <> s2")
def j13(spark, sf):
    first, second = reviews(spark, sf)
    return J.review_disagreements(first.withColumn("lang", F.col("notes")), second, carry=("source", "lang"))


VERSIONS = "o as (select doc_id as id, lang, source from documents where lang <> 'fr'), n as (select doc_id as id, case when source = 'src3' then 'xx' else lang end as lang, source from documents where source <> 'src5'), f as (select coalesce(o.id, n.id) as id, o.id as oi, n.id as ni, o.lang as ol, n.lang as nl, o.source as os, n.source as ns from o full join n on o.id = n.id), g as (select id, case when oi is null then 'added' when ni is null then 'removed' when ol <> nl then 'changed' else 'unchanged' end as change_type, case when oi is not null and ni is not null and ol <> nl then 'lang' else '' end as reason, ol as old_lang, os as old_source, nl as new_lang, ns as new_source from f)"


def versions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    old = d.where("lang <> 'fr'")
    new = d.where("source <> 'src5'").withColumn("lang", F.when(F.col("source") == "src3", "xx").otherwise(F.col("lang")))
    return J.version_diff(old, new, "id", ["lang", "source"])


@query("j14_version_diff", f"with {VERSIONS} select * from g")
def j14(spark, sf):
    return versions(spark, sf)


@query("j14_version_counts", f"with {VERSIONS} select count(*) filter (change_type = 'added') as added, count(*) filter (change_type = 'removed') as removed, count(*) filter (change_type = 'changed') as changed, count(*) filter (change_type = 'unchanged') as unchanged, count(*) filter (change_type in ('changed', 'unchanged')) as retained_total from g")
def j14b(spark, sf):
    return J.version_counts(versions(spark, sf))


REPLACE = "e as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as n from documents where source = 'src4'), r as (select event_id + 1000000 as new_id, ['en','de','fr','es'][(event_id % 4) + 1] as lang, row_number() over (partition by event_id % 4 order by event_id) as n from events), m as (select e.doc_id as old_id, new_id, lang from e join r using (lang, n))"


def replacement_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    new = table(spark, sf, "events").select((F.col("event_id") + 1000000).alias("doc_id"), F.get(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("event_id") % 4).cast("int")).alias("lang"))
    return J.replace_rows(d, d.where("source = 'src4'"), new, "doc_id", ["lang"])


@query("j15_replace_rows", f"with {REPLACE} select * from m")
def j15(spark, sf):
    return replacement_rows(spark, sf)[1]


@query("j15_replaced_table", f"with {REPLACE} select lang, count(*) as rows, sum(id)::BIGINT as ids from (select lang, doc_id as id from documents where doc_id not in (select old_id from m) union all select lang, new_id from m) group by lang")
def j15b(spark, sf):
    return replacement_rows(spark, sf)[0].groupBy("lang").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


@query("j16_eliminated_rows", f"with {REVIEWS} select sample_id, source from a where s1 = 'rejected' or sample_id in (0, 1, 2)")
def j16(spark, sf):
    first, _ = reviews(spark, sf)
    return J.eliminated_rows(first.select("sample_id", "source"), first, "sample_id", "review_status", (0, 1, 2))


@query("j17_frozen_rows_unchanged", """with kinds as (select * from (values ('as it was'), ('one text changed'), ('a row gone')) t(kind)),
a as (select kind, doc_id, case when kind = 'one text changed' and doc_id = (select max(doc_id) from documents) then text || '!' else text end as text from kinds, documents where kind <> 'a row gone' or doc_id <> (select min(doc_id) from documents)),
same as (select kind, count(*) = (select count(*) from documents) and count(*) = count(d.doc_id) as unchanged from a left join documents d on d.doc_id = a.doc_id and coalesce(d.text, '') = coalesce(a.text, '') group by kind) select * from same""")
def j17(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    ends = d.agg(F.max("doc_id").alias("last"), F.min("doc_id").alias("first"))
    e = d.join(F.broadcast(ends))  # one row
    changed = e.withColumn("text", F.when(F.col("doc_id") == F.col("last"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    cases = {"as it was": d.repartition(5), "one text changed": changed, "a row gone": e.where("doc_id <> first")}
    made = [C.same_content(d, after, "doc_id", "text").withColumn("kind", F.lit(kind)) for kind, after in cases.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


# ---- selection


def order_sql(strata: str, parts: str) -> str:
    return f"row_number() over (partition by {strata} order by sha256('42' || chr(31) || {parts}), doc_id)"


@query("p1_stratified_split", f"with r as (select doc_id, lang, {order_sql('lang', 'lang || chr(31) || doc_id::varchar')} as n, count(*) over (partition by lang) as c from documents), f as (select *, floor(c * 0.7::DOUBLE) as f1, floor(c * 0.15::DOUBLE) as f2, c * 0.7::DOUBLE - floor(c * 0.7::DOUBLE) as r1, c * 0.15::DOUBLE - floor(c * 0.15::DOUBLE) as r2 from r), g as (select *, c - f1 - 2 * f2 as rest from f), h as (select *, f1 + case when (case when r2 > r1 then 2 else 0 end) < rest then 1 else 0 end as e1, case when (case when r1 >= r2 then 1 else 0 end) < rest then 1 else 0 end as x2 from g) select doc_id, lang, case when n <= e1 then 'train' when n <= e1 + f2 + x2 then 'validation' else 'test' end as split from h")
def p1(spark, sf):
    return P.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("p2_gold_split", f"with r as (select doc_id, lang, source, {order_sql('lang, source', 'lang || chr(31) || source || chr(31) || doc_id::varchar')} as n, count(*) over (partition by lang, source) as c from documents) select doc_id, lang, source, case when n <= floor(c * 0.4::DOUBLE + 0.5) then 'calibration' else 'test' end as evaluation_split from r")
def p2(spark, sf):
    return P.gold_split(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id")


@query("p3_gold_faults", f"""with {REVIEWS}, x as (select case when {sql_number('sample_id', 13)} % 11 = 0 then 'unsure' else s1 end as s, {sql_number('sample_id', 17)} % 5 = 0 as blank, source from a),
y as (select count(*) filter (s = 'unsure') as invalid_status, count(*) filter (s = 'pending') as pending, count(*) filter (s <> 'pending' and blank) as without_reviewer, count(*) filter (s = 'verified') as verified, (select count(*) from (select source from x where s = 'verified' group by source having count(*) > 1)) as duplicate_groups from x)
select *, invalid_status = 0 and pending = 0 and without_reviewer = 0 and verified > 0 and duplicate_groups = 0 as ready from y""")
def p3(spark, sf):
    n = lambda at, k: F.pmod(number(F.col("sample_id"), at), F.lit(k))
    own = reviews(spark, sf)[0].withColumns({"review_status": F.when(n(13, 11) == 0, "unsure").otherwise(F.col("review_status")), "reviewer": F.when(n(17, 5) == 0, " ").otherwise(F.col("reviewer"))})
    return P.gold_faults(own, "review_status", "reviewer", "source")


@query("p3_build_gold", f"with {REVIEWS} select sample_id, s1 as review_status from a where s1 = 'verified'")
def p3b(spark, sf):
    ready = reviews(spark, sf)[0].where("review_status <> 'pending'")
    return P.build_gold(ready, "review_status", "reviewer", "sample_id").select("sample_id", "review_status")


@query("p4_random_stratified_split", "with r as (select doc_id, lang, row_number() over (partition by lang order by sha256('42' || chr(31) || doc_id::varchar), doc_id) as n, count(*) over (partition by lang) as c from documents) select doc_id, lang, case when n <= round(c * 0.2::DOUBLE) then 'test' else 'train' end as split from r")
def p4(spark, sf):
    return P.random_stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


#: One row after another in order of labels and ids: taken holds the keys of all rows selected so far, k how many their label has.
P5_SQL = """with recursive r as (select *, row_number() over (order by o, doc_id) as n from (select doc_id, lang, o, quota, 'e' || md5(text) as e, 'f' || md5(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as f from documents join (values ('en', 1, 80), ('de', 2, 60), ('fr', 3, 60), ('es', 4, 30)) q(l, o, quota) on l = lang where text is not null)),
s as (select 0::BIGINT as n, 0 as o, 0 as k, false as p, []::VARCHAR[] as taken union all select n, o, k + p::INT, p, case when p then list_concat(taken, [e, f]) else taken end from
(select *, k < quota and not list_contains(taken, e) and not list_contains(taken, f) as p from (select r.n, r.o, r.e, r.f, r.quota, s.taken, case when r.o = s.o then s.k else 0 end as k from s join r on r.n = s.n + 1)))
select doc_id, lang from s join r using (n) where p"""


@query("p5_quota_unique_select", P5_SQL)
def p5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("exact"), F.md5(F.lower(N.trim(F.col("text")))).alias("folded"))
    return P.quota_unique_select(d, ["exact", "folded"], "lang", {"en": 80, "de": 60, "fr": 60, "es": 30}, "doc_id", write=stored).select("doc_id", "lang")


@query("p6_quota_coverage", "with t as (select * from (values ('en', 80), ('de', 500), ('xx', 3)) t(label, target)) select t.label, target::BIGINT as target, count(d.doc_id) as actual, count(distinct d.source) as unique, greatest(0, target - count(d.doc_id))::BIGINT as shortfall from t left join documents d on d.lang = t.label group by t.label, target")
def p6(spark, sf):
    return P.quota_coverage(table(spark, sf, "documents"), "lang", "source", {"en": 80, "de": 500, "xx": 3})


@query("p7_oversample", "with c as (select lang, count(*) as n from documents group by lang) select d.doc_id, d.lang, greatest(1, ceil(400 / n::DOUBLE))::BIGINT as copies from documents d join c using (lang)")
def p7(spark, sf):
    return P.oversample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 400).groupBy("doc_id", "lang").agg(F.count("*").alias("copies"))


@query("p8_template_augment", """with w as (select distinct lang as label, unnest(string_split_regex(lower(text), '\\s+')) as word from documents), t as (select * from (select *, row_number() over (partition by label order by md5('42' || chr(31) || word), word) as n from w where length(word) > 3) where n <= 50),
r as (select label, word, unnest(['say {}', '{} again', 'no {} here']) as t from t), p as (select *, ('0x' || substr(md5('42' || chr(31) || word || chr(31) || t), 1, 4))::INT % 3 as p from r)
select label, word, replace(t, '{}', ['', 'the ', ''][p + 1] || word || ['', '', '!'][p + 1]) as text from p""")
def p8(spark, sf):
    words = table(spark, sf, "documents").select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("length(word) > 3")
    return P.template_augment(words, "word", "lang", ["say {}", "{} again", "no {} here"], [("", ""), ("the ", ""), ("", "!")])


@query("p9_validate_distribution", "with g as (select lang, count(*) as actual from documents group by lang) select lang, actual + (case when lang in ('de', 'fr') then 1 else 0 end) as expected, actual from g where lang in ('de', 'fr')")
def p9(spark, sf):
    d = table(spark, sf, "documents")
    expected = d.groupBy("lang").agg((F.count("*") + F.when(F.col("lang").isin("de", "fr"), 1).otherwise(0)).alias("expected"))
    return P.validate_distribution(d, ["lang"], expected)


@query("p9_id_faults", f"with {REVIEWS} select count(*) filter (sample_id <> sample_id - sample_id % 2) as wrong_ids, count(*) filter (s1 <> 'pending') as not_pending, 0::BIGINT as repeated_ids from a")
def p9b(spark, sf):
    return P.id_faults(reviews(spark, sf)[0], "sample_id", F.col("sample_id") - F.col("sample_id") % 2, "review_status")


@query("p10_review_summary", f"with {REVIEWS} select source as kind, count(*) filter (s1 = 'verified') as verified, count(*) filter (s1 = 'pending') as pending, count(*) filter (s1 = 'rejected') as rejected, count(*) as total, 0::BIGINT as invalid, round(count(*) filter (s1 = 'verified') / count(*)::DOUBLE, 4) as verified_rate from a group by source")
def p10(spark, sf):
    return P.review_summary(reviews(spark, sf)[0], "source", "review_status")


@query("p11_targeted_review_pick", "with r as (select doc_id, source, row_number() over (partition by source order by case when lang = 'de' then 0 else 1 end, doc_id) as n from documents where source in ('src1', 'src2')) select doc_id from r where n <= 3 union select doc_id from documents where contains(text, '@')")
def p11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return P.targeted_review_pick(d, "source", "doc_id", ["src1", "src2"], F.when(F.col("lang") == "de", 0).otherwise(1), F.contains("text", F.lit("@"))).select("doc_id")


def structures(spark, sf):
    d = table(spark, sf, "documents")
    n = lambda at, k: F.pmod(number(F.col("doc_id"), at), F.lit(k))
    return d.select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("label"), "text", F.substring("text", 3, 5).alias("risk_fragment"), F.replace("text", F.substring("text", 3, 5), F.lit("***")).alias("sanitized_text"), F.substring("text", 1, 20).alias("template_signature"),
        F.concat(F.lit("s"), n(1, 6).cast("string")).alias("structure_type"), F.get(F.array(F.lit("start"), F.lit("middle"), F.lit("end")), n(5, 3).cast("int")).alias("risk_position"), F.concat(F.lit("o"), n(9, 4).cast("string")).alias("sanitize_operation"),
        (n(13, 50) == 0).alias("obvious"), F.when(n(17, 9) == 0, "open").otherwise("accepted").alias("linkage_status"), F.when(n(21, 20) == 0, "").otherwise("ctx").alias("legal_context"), F.lit("why").alias("linkage_reason"),
    )


@query("p12_structure_gates", f"""with s as (select doc_id, lang, text, substr(text, 3, 5) as f, case when substr(text, 3, 5) = '' then text else replace(text, substr(text, 3, 5), '***') end as r, substr(text, 1, 20) as sig, {sql_number('doc_id', 1)} % 6 as st, {sql_number('doc_id', 5)} % 3 = 2 as last, {sql_number('doc_id', 9)} % 4 as op, {sql_number('doc_id', 13)} % 50 = 0 as obvious from documents),
a as (select count(*) as rows, count(*) filter (f = '' or not contains(text, f)) as missing_fragment, count(*) filter (trim(r) = '' or r = text or (f <> '' and contains(r, f))) as invalid_rewrite, count(*) filter (contains(text, 'please')) as meta_phrases, count(*) filter (obvious) as flag_obvious from s),
b as (select coalesce(sum(c - 1), 0)::BIGINT as repeated_signatures from (select count(*) as c from s group by sig having count(*) > 1)),
g as (select lang, st, count(*) as c, count(*) filter (last) as e from s group by all), o as (select lang, count(distinct op) as ops from s group by lang),
l as (select bool_and(x.structures >= 4 and ops >= 3 and top / n::DOUBLE <= 0.4 and ends / n::DOUBLE <= 0.4) as label_gates from (select lang, max(c) as top, sum(c) as n, sum(e) as ends, count(*) as structures from g group by lang) x join o using (lang))
select *, missing_fragment = 0 and invalid_rewrite = 0 and meta_phrases = 0 and repeated_signatures = 0 and flag_obvious = 0 and label_gates as passed from a, b, l""")
def p12(spark, sf):
    return P.structure_gates(structures(spark, sf), meta=["please"], flags=["obvious"])


@query("p13_linkage_gates", f"with s as (select doc_id as sample_id, substr(text, 3, 5) as f, {sql_number('doc_id', 17)} % 9 = 0 as open, {sql_number('doc_id', 21)} % 20 = 0 as blank, source from documents) select count(*) filter (not open) as accepted, count(*) filter (open) as not_accepted, count(*) filter (blank) as missing_legal_context, 0::BIGINT as missing_linkage_reason, count(*) filter (trim(f) = '') as missing_risk_fragment, 0::BIGINT as repeated_ids, count(*) filter (source = 'src1') as unexpected_ids, 0::BIGINT as absent_ids, count(*) filter (source = 'src2') as forbidden_ids, false as passed from s")
def p13(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "source")
    return P.linkage_gates(structures(spark, sf), ids.where("source <> 'src1'"), ids.where("source = 'src2'"))


@query("p14_publish_if_passed", "select doc_id, lang, source, n_chars, md5(text) as text from documents")
def p14(spark, sf):
    d, path = table(spark, sf, "documents"), place(spark, "published")
    gates = d.agg((F.count("*") > 0).alias("passed"))
    failed = gates.select((~F.col("passed")).alias("passed"))
    if not P.publish_if_passed(d, gates, path) or P.publish_if_passed(d.where("lang = 'en'"), gates.union(failed), path):
        raise ValueError("gates")
    return spark.read.parquet(path).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text"))  # the second one wrote nothing


@query("p15_validate_manifest", f"select count(*) as rows, count(*) filter (lang = 'es') as bad_labels, count(*) filter ({SPLIT_SQL} = 'validation') as bad_splits, false as valid from documents")
def p15(spark, sf):
    return P.validate_manifest(split_docs(spark, sf), ["text", "lang", "split"], ["en", "de", "fr"], ["train", "test"], "lang")


@query("p16_partition_xy", f"select md5(text) as text, lang as label from documents where {SPLIT_SQL} = 'test'")
def p16(spark, sf):
    return P.partition_xy(split_docs(spark, sf), "test", label="lang").withColumn("text", F.md5("text"))


@query("p17_number_replacements", "select doc_id, 'replacement:' || lang || ':' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end as source_reference from (select doc_id, lang, row_number() over (partition by lang order by sha256(doc_id::varchar), doc_id) as n from documents)")
def p17(spark, sf):
    return P.number_replacements(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id").select("doc_id", "source_reference")


@query("p17_replacement_faults", "with g as (select lang, count(*) as n from documents group by lang) select (select count(*) from g where lang in ('de', 'fr')) as wrong_strata, 0::BIGINT as repeated_ids, (select count(*) from documents where source = 'src2') as forbidden_ids, false as valid")
def p17b(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    expected = d.groupBy("lang").agg((F.count("*") + F.when(F.col("lang").isin("de", "fr"), 1).otherwise(0)).alias("expected"))
    return P.replacement_faults(d, ["lang"], "doc_id", expected, d.where("source = 'src2'"))


SPEC_TYPES = (*tuple(LINKAGE_MECHANISMS), "other_pollution")
SPECS_SQL = f"""n as (select *, {sql_number('doc_id', 1)} as a, {sql_number('doc_id', 5)} as b, {sql_number('doc_id', 9)} as c from documents),
m as (select 'siev1_' || substr(sha256(lang || chr(31) || text), 1, 16) as sample_id, doc_id, lang as label, text, {sql_list(SPEC_TYPES)}[a % {len(SPEC_TYPES)} + 1] as structure_type, ['start', 'middle', 'end'][b % 3 + 1] as risk_position, 'o' || c % 4 as sanitize_operation, substr(text, 3, 5) as risk_fragment, case when substr(text, 3, 5) = '' then text else replace(text, substr(text, 3, 5), '***') end as sanitized_text, substr(text, 1, 20) as template_signature, case when b % 7 = 0 then '' else 'of ' || source end as semantic_relation, a % 50 = 0 as obvious_two_part, b % 2 = 0 as safe_context_reference, coalesce(case when c % 3 > 0 then c % 3 = 1 end, false) as severe_core_intent, false as uses_real_identifier from n)"""


def specs(spark, sf):
    n = lambda at, k: F.pmod(number(F.col("doc_id"), at), F.lit(k))
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), n(at, len(words)).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("label"), "text", pick(SPEC_TYPES, 1).alias("structure_type"), pick(("start", "middle", "end"), 5).alias("risk_position"), F.concat(F.lit("o"), n(9, 4).cast("string")).alias("sanitize_operation"),
        F.substring("text", 3, 5).alias("risk_fragment"), F.replace("text", F.substring("text", 3, 5), F.lit("***")).alias("sanitized_text"), F.substring("text", 1, 20).alias("template_signature"), F.when(n(5, 7) != 0, F.concat(F.lit("of "), F.col("source"))).alias("semantic_relation"),
        (n(1, 50) == 0).alias("obvious_two_part"), (n(5, 2) == 0).alias("safe_context_reference"), F.when(n(9, 3) > 0, n(9, 3) == 1).alias("severe_core_intent"), F.lit(False).alias("uses_real_identifier"),
    )


@query("p18_structure_metadata", f"with {SPECS_SQL} select sample_id, label, md5(text) as text, structure_type, risk_position, sanitize_operation, risk_fragment, md5(sanitized_text) as sanitized_text, template_signature, semantic_relation, obvious_two_part::VARCHAR as obvious_two_part, safe_context_reference::VARCHAR as safe_context_reference, severe_core_intent::VARCHAR as severe_core_intent, uses_real_identifier::VARCHAR as uses_real_identifier from m")
def p18(spark, sf):
    return P.structure_metadata(specs(spark, sf)).withColumns({"text": F.md5("text"), "sanitized_text": F.md5("sanitized_text")})


@query("p18_linkage_rows", f"with {SPECS_SQL}, w as (select unnest({sql_list(LINKAGE_MECHANISMS)}) as k, unnest({sql_list(LINKAGE_MECHANISMS.values())}) as mechanism) select sample_id, label, md5(text) as text, structure_type, risk_position, sanitize_operation, md5(sanitized_text) as legal_context, risk_fragment, semantic_relation || '；' || coalesce(mechanism, '{LINKAGE_DEFAULT}') || '，{LINKAGE_CLOSING}' as linkage_reason, 'linked' as linkage_status, '{LINKAGE_NOTE}' as notes from m left join w on k = structure_type")
def p18b(spark, sf):
    return P.linkage_rows(P.structure_metadata(specs(spark, sf))).withColumns({"text": F.md5("text"), "legal_context": F.md5("legal_context")})


@query("p19_evaluation_coverage", "select 'lang' as dimension, lang as name, count(*) as count from documents group by lang union all select 'source', source, count(*) from documents group by source")
def p19(spark, sf):
    return P.evaluation_coverage(table(spark, sf, "documents"), ["lang", "source"])


@query("p19_coverage_rows", f"""with {SIDES}, lk as (select distinct ev.id from ev join tr on ev.k = tr.k), c as (select 'lang' as dimension, lang as name, count(*) as count from documents group by lang)
select * from c union all select 'shortfall_lang', t.lang, greatest(0, t.target - coalesce(count, 0))::BIGINT from (values ('en', 900), ('de', 900), ('xx', 3)) t(lang, target) left join c on c.name = t.lang
union all select 'duplicates', 'all', count(*) from (select 1 from documents group by text having count(*) > 1) union all select 'leakage', 'all', count(*) from lk""")
def p19b(spark, sf):
    d = table(spark, sf, "documents")
    train, ev = sides(spark, sf)
    return P.coverage_rows(d, ["lang"], {"lang": {"en": 900, "de": 900, "xx": 3}}, d.groupBy("text").count().where("count > 1"), J.find_leakage(train, ev, keys()).select("eval_id").distinct())


# ---- disguise

WORDS = {"en": ("tion", "heat", "the"), "de": ("undch", "ver"), "fr": ("eau", "tion"), "es": ("ción", "mente")}
ENTRIES = {
    "homophone": [("shun", "tion", 0.95, "high", "sounds alike", "homophone"), ("fer", "ver", 0.8, "medium", "", "homophone"), ("x", "the", 0.5, "low", "", "homophone")],
    "pinyin": [("uo", "eau", 0.9, "high", "", ""), ("zz", "nd", 0.6, "low", "", "")],
    "abbreviation": [("&", "and", 0.85, "medium", "", "")],
    "emoji": [("☀", "heat", 0.75, "low", "", "emoji")],
}
G_RULES = G.Rules(ENTRIES, WORDS, (("with", "mit"), ("de ", "of ")))


def seeds(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))


def first_sql(old: str, new: str) -> str:
    return f"substr(text, 1, strpos(text, {old}) - 1) || {new} || substr(text, strpos(text, {old}) + length({old}))"


def changed(spark, sf, made):
    df = seeds(spark, sf).withColumn("c", made).where("c is not null")
    return df.select("doc_id", F.md5("c.text").alias("text"), F.col("c.note").alias("note"))


@query("g1_map_replace", f"select doc_id, md5({first_sql(chr(39) + 'eau' + chr(39), chr(39) + 'uo' + chr(39))}) as text, 'high-confidence map replacement (0.90)' as note from documents where contains(text, 'eau')")
def g1(spark, sf):
    return changed(spark, sf, G.map_replace(F.col("text"), ENTRIES["pinyin"]))


@query("g2_homophone_replace", f"select doc_id, md5(case when contains(text, 'tion') then {first_sql(chr(39) + 'tion' + chr(39), chr(39) + 'shun' + chr(39))} else {first_sql(chr(39) + 'ver' + chr(39), chr(39) + 'fer' + chr(39))} end) as text, case when contains(text, 'tion') then 'homophone confidence=high; sounds alike' else 'homophone confidence=medium; high-priority manual review required' end as note from documents where contains(text, 'tion') or contains(text, 'ver')")
def g2(spark, sf):
    return changed(spark, sf, G.homophone_replace(F.col("text"), ENTRIES["homophone"]))


@query("g3_variant_char_replace", "select doc_id, md5(substr(t, 1, strpos(t, '暴力') - 1) || '曓力' || substr(t, strpos(t, '暴力') + 2)) as text, 'explicit variant-character replacement; looks alike' as note from (select doc_id, replace(text, 'the', '暴力') as t from documents) where contains(t, '暴力')")
def g3(spark, sf):
    df = seeds(spark, sf).withColumn("t", F.replace("text", F.lit("the"), F.lit("暴力")))
    made = G.variant_replace(F.col("t"), [("曓力", "暴力", 0.9, "high", "looks alike", "visual_variant"), ("网", "暴力", 0.9, "high", "x", "visual_variant")])
    return df.withColumn("c", made).where("c is not null").select("doc_id", F.md5("c.text").alias("text"), F.col("c.note").alias("note"))


_PHONE = "(^|[^0-9])(1[3-9][0-9]{9})($|[^0-9])"


@query("g4_obfuscate_phone", f"with t as (select doc_id, substr(text, 1, 40) || ' 138' || lpad(doc_id::VARCHAR, 8, '0') || ' ' || text as t from documents), m as (select *, regexp_extract(t, '{_PHONE}', 2) as m from t) select doc_id, md5(regexp_replace(t, '{_PHONE}', '\\1' || array_to_string(regexp_extract_all(m, '.'), '-') || '\\3')) as text from m where m <> ''")
def g4(spark, sf):
    df = seeds(spark, sf).withColumn("text", F.concat(F.substring("text", 1, 40), F.lit(" 138"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(" "), F.col("text")))
    return df.select("doc_id", G.obfuscate_phone(F.col("text")).alias("c")).where("c is not null").select("doc_id", F.md5("c.text").alias("text"))


@query("g5_obfuscate_url", "select page_id, replace(regexp_replace(url, '^http', 'hxxp'), '.', '[.]') as url from pages")
def g5(spark, sf):
    return table(spark, sf, "pages").select("page_id", G.obfuscate_url(F.col("url")).alias("c")).where("c is not null").select("page_id", F.col("c.text").alias("url"))


KEYWORD = "case lang " + " ".join(f"when '{a}' then case " + " ".join(f"when contains(text, '{w}') then '{w}'" for w in ws) + " end" for a, ws in WORDS.items()) + " end"
WORD_SQL = f"with k as (select doc_id, text, {KEYWORD} as w from documents)"


@query("g6_repeat_keyword_char", f"{WORD_SQL} select doc_id, md5({first_sql('w', 'substr(w, 1, 1) || w')}) as text, 'repeat character inside risk keyword: ' || w as note from k where w is not null")
def g6(spark, sf):
    return changed(spark, sf, G.perturb(F.col("text"), F.col("label"), "repeat_character", G_RULES))


@query("g7_to_traditional", "select doc_id, md5(translate(t, '后发网术学', '後發網術學')) as text from (select doc_id, replace(text, 'the', '网学') as t from documents) where contains(t, '网学')")
def g7(spark, sf):
    df = seeds(spark, sf).withColumn("c", G.to_traditional(F.replace("text", F.lit("the"), F.lit("网学")))).where("c is not null")
    return df.select("doc_id", F.md5("c.text").alias("text"))


@query("g8_space_insert", f"{WORD_SQL} select doc_id, md5({first_sql('w', chr(97) + 'rray_to_string(string_split(w, ' + chr(39) * 2 + '), ' + chr(39) + ' ' + chr(39) + ')')}) as text, 'insert spaces inside risk keyword: ' || w as note from k where w is not null and length(text) >= 2")
def g8(spark, sf):
    return changed(spark, sf, G.perturb(F.col("text"), F.col("label"), "space_insertion", G_RULES))


@query("g9_symbol_insert", f"{WORD_SQL} select doc_id, md5({first_sql('w', 'substr(w, 1, 1) || ' + chr(39) + '@' + chr(39) + ' || substr(w, 2)')}) as text, 'insert symbol inside risk keyword: ' || w as note from k where w is not null and length(text) >= 2")
def g9(spark, sf):
    return changed(spark, sf, G.perturb(F.col("text"), F.col("label"), "symbol_insertion", G_RULES))


@query("g10_mixed_language", f"select doc_id, md5(case when contains(text, 'with') then {first_sql(chr(39) + 'with' + chr(39), chr(39) + 'mit' + chr(39))} else {first_sql(chr(39) + 'de ' + chr(39), chr(39) + 'of ' + chr(39))} end) as text, case when contains(text, 'with') then 'replace with with mit' else 'replace de  with of ' end as note from documents where contains(text, 'with') or contains(text, 'de ')")
def g10(spark, sf):
    return changed(spark, sf, G.mixed_language(F.col("text"), G_RULES.mixed))


LOOSE_RULES = G.Rules({**ENTRIES, "variant_char": [("đ", "d", 0.5, "low", "", ""), ("ŧhe", "the", 0.5, "low", "", "")]}, WORDS, G_RULES.mixed)


def loose_sql(texts: str, rules: G.Rules) -> str:
    """CTEs up to `lv` (doc_id, label, text, i, kind, t, note): every text under every kind of the first version's rules."""
    quote = lambda w: "'" + w + "'"
    maps = {"homophone": "homophone", "pinyin": "pinyin", "abbreviation": "abbreviation", "variant_character": "variant_char", "emoji": "emoji"}
    made = {}
    for kind, name in maps.items():
        entries = G.ordered_entries(rules.maps.get(name, ()))
        cases = " ".join(f"when contains(text, {quote(e[1])}) then {first_sql(quote(e[1]), quote(e[0]))}" for e in entries)
        made[kind] = (f"case {cases} end" if entries else "null", f"'reverse replacement from {name}_map'")
    made["traditional_simplified"] = ("nullif(translate(text, '网学', '網學'), text)", "'fixed simplified-to-traditional character table'")
    made["phone_obfuscation"] = (f"case when ph <> '' then {first_sql('ph', 'array_to_string(regexp_extract_all(ph, chr(46)), chr(45))')} end", "'hyphenate phone digits'")
    made["url_obfuscation"] = ("case when ur <> '' then substr(text, 1, strpos(text, ur) - 1) || replace(substr(text, strpos(text, ur)), '.', '[.]') end", "'replace URL dots with [.]'")
    made["repeat_character"] = (f"case when w is not null then {first_sql('w', 'substr(w, 1, 1) || w')} end", "'repeat inside risk keyword: ' || w")
    made["character_split"] = ("substr(text, 1, 1) || ' ' || substr(text, 2)", "'split first two characters'")
    made["space_insertion"] = ("substr(regexp_replace(text, '(?s)(.)', '\\1 ', 'g'), 1, 2 * length(text) - 1)", "'insert spaces between all characters'")
    made["symbol_insertion"] = ("substr(text, 1, 1) || '@' || substr(text, 2)", "'insert @ after first character'")
    cases = " ".join(f"when contains(text, {quote(a)}) then {{}}" for a, _ in rules.mixed)
    made["mixed_language"] = (f"case {cases} else text || ' online' end".format(*(first_sql(quote(a), quote(b)) for a, b in rules.mixed)), f"case {cases} else 'append mixed-language context token' end".format(*(f"'replace {a} with {b}'" for a, b in rules.mixed)))
    short = ("phone_obfuscation", "repeat_character", "character_split", "space_insertion", "symbol_insertion", "mixed_language")
    parts = " union all ".join(f"select doc_id, label, text, {i} as i, '{k}' as kind, {made[k][0]} as t, {made[k][1]} as note from lx where {'length(text) >= 2' if k in short else 'true'}" for i, k in enumerate(KINDS))
    word = "case " + " ".join(f"when contains(text, '{w}') then '{w}'" for ws in rules.keywords.values() for w in ws) + " end"
    return f"ls as ({texts}), lx as (select *, {word} as w, regexp_extract(text, '1[3-9][0-9]{{9}}') as ph, regexp_extract(text, '(?i)https?://|www\\.') as ur from ls), lv as (select * from ({parts}) where t is not null)"


@query("g11_perturb_loose", "with " + loose_sql(f"select doc_id, lang as label, case when {sql_number('doc_id', 1)} % 2 = 0 then '网学 ' || text || ' 138' || lpad(doc_id::VARCHAR, 8, '0') || ' https://a.b/' || source || '.html' else text end as text from documents", LOOSE_RULES) + " select doc_id, kind, md5(t) as text, note from lv")
def g11(spark, sf):
    more = F.concat(F.lit("网学 "), F.col("text"), F.lit(" 138"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(" https://a.b/"), F.col("source"), F.lit(".html"))
    own = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"), F.when(F.pmod(number(F.col("doc_id"), 1), F.lit(2)) == 0, more).otherwise(F.col("text")).alias("text"))
    return G.variants(own, LOOSE_RULES, loose=True).select("doc_id", F.col("perturbation_type").alias("kind"), F.md5("adversarial_text").alias("text"), F.col("notes").alias("note"))


V1_SQL = loose_sql("select doc_id, lang as label, text from documents", G_RULES) + """, lf as (select kind, t, min(doc_id) as doc_id from lv group by all), lr as (select *, row_number() over (partition by kind order by doc_id, t) as n from lf),
v1 as (select kind, doc_id, label, text, t, note, n, 'pair_' || substr(sha256(concat_ws(chr(31), text, label, 'adversarial_v1')), 1, 16) as pair_id, 'adv_' || substr(sha256(concat_ws(chr(31), t, label, 'adversarial_v1:' || kind)), 1, 16) as sample_id from lv join lr using (kind, t, doc_id) where n <= 10)"""
#: Two sets: the first has fewer variants a kind, the second lacks two kinds and notes one anew.
V1_NEXT_SQL = f"""{V1_SQL}, old as (select * from v1 where n <= 8), new as (select * replace (case when kind = 'emoji' then 'seen' else note end as note) from v1 where kind not in {(*DEPRECATED_KINDS, 'homophone')}),
df as (select o.sample_id as old_id, w.sample_id as new_id, coalesce(w.text, o.text) as text, coalesce(w.label, o.label) as label, o.t as ot, w.t as wt, o.kind as ok, w.kind as wk, case when w.sample_id is null then 'removed' when o.sample_id is null then 'added' when o.note = w.note then 'unchanged' else 'changed' end as change_type from old o full join new w on o.sample_id = w.sample_id)"""


def v1(spark, sf, most=10):
    return G.build_v1(seeds(spark, sf), G_RULES, "doc_id", most)


def v1_pair(spark, sf):
    """The second set and the first."""
    kind = F.col("perturbation_type")
    new = v1(spark, sf).where(~kind.isin(*DEPRECATED_KINDS, "homophone")).withColumn("notes", F.when(kind == "emoji", "seen").otherwise(F.col("notes")))
    return stored(new, "new"), stored(v1(spark, sf, 8), "old")


@query("g16_variant_diff", f"with {V1_NEXT_SQL} select change_type, coalesce(old_id, '') as old_id, coalesce(new_id, '') as new_id, md5(text) as original_text, md5(coalesce(ot, '')) as old_text, md5(coalesce(wt, '')) as new_text, label, coalesce(ok, '') as old_kind, coalesce(wk, '') as new_kind, case change_type when 'removed' then case ok when 'character_split' then 'character_split deprecated' when 'homophone' then 'low-confidence homophone excluded' else 'removed by quality rules' end when 'added' then 'strict generation' when 'changed' then 'generation metadata updated' else '' end as reason from df")
def g16b(spark, sf):
    new, old = v1_pair(spark, sf)
    return G.variant_diff(old, new).withColumns({c: F.md5(c) for c in ("original_text", "old_text", "new_text")})


CELLS_SQL = f"""cells as (select x.l as label, k as kind, x.t as target from (select unnest([{', '.join(f"{{'l': '{a}', 't': {t}}}" for a, t in {'en': 3, 'de': 3, 'fr': 2, 'es': 2}.items())}]) as x), (select unnest({sql_list(KINDS)}) as k)),
short as (select c.label, c.kind, any_value(target) as target, count(v.kind) as actual, greatest(0, any_value(target) - count(v.kind)) as shortfall from cells c left join made v on v.label = c.label and v.kind = c.kind group by 1, 2)"""


SHORTFALL_ROWS = f"select label, kind as perturbation_type, target::BIGINT as target, actual, shortfall::BIGINT as shortfall, case when shortfall = 0 then '' when kind in {DEPRECATED_KINDS[:1] * 2} then 'deprecated' else 'insufficient_candidates' end as reason from short"


@query("g15_shortfall_v1", f"with {V1_SQL}, made as (select * from v1), {CELLS_SQL} {SHORTFALL_ROWS}")
def g15b(spark, sf):
    return G.generation_shortfall(v1(spark, sf), G_TARGETS)


@query("g16_coverage_report", f"""with {V1_NEXT_SQL}, made as (select * from new), {CELLS_SQL}
select 'total' as dimension, null as kind, null as label, count(*) as count from made union all select 'kind', kind, null, count(*) from made group by kind union all select 'label', null, label, count(*) from made group by label
union all select 'label_kind', kind, label, actual from short union all select 'shortfall', kind, null, sum(shortfall)::BIGINT from short group by kind union all select 'shortfall_total', null, null, sum(shortfall)::BIGINT from short
union all select 'duplicate_pairs', null, null, count(*) from made a join made b on a.pair_id = b.pair_id and a.sample_id < b.sample_id
union all select 'diff', c, null, count(change_type) from (select unnest(['added', 'changed', 'removed', 'unchanged']) as c) left join df on change_type = c group by c""")
def g16c(spark, sf):
    new, old = v1_pair(spark, sf)
    ids = new.select("pair_id", "sample_id")  # at most ten rows a kind
    pairs = ids.join(ids.withColumnRenamed("sample_id", "other"), "pair_id").where("sample_id < other")
    return G.coverage_report(new, pairs, G.variant_diff(old, new), G_TARGETS)


@query("g12_build_adversarial_v1", f"with {V1_SQL} select kind as perturbation_type, doc_id, sample_id, pair_id from v1")
def g12(spark, sf):
    return G.build_v1(seeds(spark, sf), G_RULES, "doc_id").select("perturbation_type", "doc_id", "sample_id", "pair_id")


G_TARGETS = {"en": 3, "de": 3, "fr": 2, "es": 2}


def strict_sql(texts: str, rules: G.Rules) -> str:
    """CTEs up to `sv` (doc_id, label, text, i, kind, t, note): every text under every strict kind; rules without a map of variant characters."""
    quote = lambda w: "'" + w + "'"

    def by_map(name, wanted, note):
        own = [e for e in G.ordered_entries(rules.maps.get(name, ())) if wanted(e)]
        cases = lambda said: "case " + " ".join(f"when contains(text, {quote(e[1])}) then {said(e)}" for e in own) + " end"
        return (cases(lambda e: first_sql(quote(e[1]), quote(e[0]))), cases(lambda e: quote(note(e)))) if own else ("null::VARCHAR", "null::VARCHAR")

    def by_word(new, note):
        return f"case when w is not null then {first_sql('w', new)} end", f"'{note}: ' || w"

    spaced = "array_to_string(string_split(w, ''), ' ')"
    sure = lambda e: f"high-confidence map replacement ({e[2]:.2f})"
    mixed = lambda said: "case " + " ".join(f"when contains(text, {quote(a)}) then {said(a, b)}" for a, b in rules.mixed) + " end"
    made = {
        "homophone": by_map("homophone", lambda e: e[3] in ("high", "medium"), G.homophone_note),
        "pinyin": by_map("pinyin", lambda e: e[2] >= 0.85, sure),
        "abbreviation": by_map("abbreviation", lambda e: e[2] >= 0.85, sure),
        "variant_character": ("null::VARCHAR", "null::VARCHAR"),
        "traditional_simplified": ("nullif(translate(text, '网学', '網學'), text)", "'fixed simplified-to-traditional character table'"),
        "character_split": by_word(spaced, "split risk keyword"),
        "space_insertion": by_word(spaced, "insert spaces inside risk keyword"),
        "symbol_insertion": by_word("substr(w, 1, 1) || '@' || substr(w, 2)", "insert symbol inside risk keyword"),
        "emoji": by_map("emoji", lambda e: e[2] >= 0.70, lambda e: "replace core risk expression with mapped emoji"),
        "mixed_language": (mixed(lambda a, b: first_sql(quote(a), quote(b))), mixed(lambda a, b: f"'replace {a} with {b}'")),
        "url_obfuscation": (f"case when ur <> '' then {first_sql('ur', 'replace(regexp_replace(regexp_replace(ur, ' + quote('(?i)^https') + ', ' + quote('hxxps') + '), ' + quote('(?i)^http') + ', ' + quote('hxxp') + '), chr(46), ' + quote('[.]') + ')')} end", "'obfuscate existing URL scheme and dots'"),
        "phone_obfuscation": (f"case when ph <> '' then regexp_replace(text, '{_PHONE}', '\\1' || array_to_string(regexp_extract_all(ph, '.'), '-') || '\\3') end", "'hyphenate existing phone number'"),
        "repeat_character": by_word("substr(w, 1, 1) || w", "repeat character inside risk keyword"),
    }
    short = ("character_split", "space_insertion", "symbol_insertion", "mixed_language")
    parts = " union all ".join(f"select doc_id, label, text, {i} as i, '{k}' as kind, {made[k][0]} as t, {made[k][1]} as note from sx where {'length(text) >= 2' if k in short else 'true'}" for i, k in enumerate(KINDS))
    word = "case label " + " ".join(f"when '{a}' then case " + " ".join(f"when contains(text, '{w}') then '{w}'" for w in ws) + " end" for a, ws in rules.keywords.items()) + " end"
    return f"ss as ({texts}), sx as (select *, {word} as w, regexp_extract(text, '{_PHONE}', 2) as ph, regexp_extract(text, '(?i)(?:https?://|www\\.)[^\\s，。；、]+') as ur from ss), sv as (select * from ({parts}) where t is not null)"


#: Blocks of kind and label one after another: taken holds the texts of all blocks so far, own what the block takes.
V2_SQL = f"""with recursive {strict_sql("select doc_id, lang as label, text from documents", G_RULES)},
q as (select unnest({sql_list(G_TARGETS)}) as label, unnest(range({len(G_TARGETS)})) as place, unnest([{', '.join(map(str, G_TARGETS.values()))}]) as quota),
first as (select i * {len(G_TARGETS)} + place as b, quota, label, kind, t, min(doc_id) as doc_id from sv join q using (label) group by all),
block as (select range as b, any_value(quota) as quota, list(t order by doc_id, t) filter (t is not null) as ts from range({len(G_TARGETS) * len(KINDS)}) left join first on b = range group by range),
taking as (select -1::BIGINT as b, []::VARCHAR[] as taken, []::VARCHAR[] as own union all
select b, list_concat(taken, own), own from (select n.b, s.taken, coalesce(list_filter(n.ts, lambda x: not list_contains(s.taken, x))[1:n.quota], []) as own from taking s join block n on n.b = s.b + 1)),
v2 as (select f.kind, f.label, f.doc_id, f.t, v.text, v.note, 'pair_' || substr(sha256(concat_ws(chr(31), v.text, v.label, 'adversarial_v2')), 1, 16) as pair_id, 'adv_' || substr(sha256(concat_ws(chr(31), f.t, v.label, 'adversarial_v2:' || v.kind)), 1, 16) as sample_id
from (select b, unnest(own) as t from taking) c join first f on f.b = c.b and f.t = c.t join sv v on v.kind = f.kind and v.doc_id = f.doc_id)"""


def v2(spark, sf):
    return stored(G.build_v2(seeds(spark, sf), G_RULES, "doc_id", G_TARGETS))


@query("g13_build_adversarial_v2", f"{V2_SQL} select kind as perturbation_type, label, doc_id, sample_id, pair_id from v2")
def g13(spark, sf):
    return v2(spark, sf).select("perturbation_type", "label", "doc_id", "sample_id", "pair_id")


@query("g14_build_adversarial_v3", f"{V2_SQL} select kind as perturbation_type, label, doc_id, note as notes, 'pending' as review_status from v2 where kind not in {(*DEPRECATED_KINDS, 'variant_character')}")
def g14(spark, sf):
    return G.build_v3(v2(spark, sf), G_RULES, seeds(spark, sf), "doc_id").select("perturbation_type", "label", "doc_id", "notes", "review_status")


@query("g15_generation_shortfall", f"{V2_SQL}, made as (select * from v2), {CELLS_SQL} {SHORTFALL_ROWS}")
def g15(spark, sf):
    return G.generation_shortfall(v2(spark, sf), G_TARGETS)


@query("g16_adversarial_coverage", f"{V2_SQL} select kind, label, count(*) as count, count(distinct pair_id) as pairs from v2 group by cube (kind, label)")
def g16(spark, sf):
    return G.adversarial_coverage(v2(spark, sf))


# ---- models


def tfidf_sql(grams: str, fit: str = "true", keep: str = "true", most: int | None = None) -> str:
    """CTEs up to `y` (doc_id, g, i, tf, df, weight): the dictionary from the documents where `fit`, the weights of all."""
    return f"""w as (select doc_id, {fit} as fit, {grams} as gs from docs), g as (select doc_id, fit, unnest(gs) as g from w),
tf as (select doc_id, fit, g, count(*) as tf from g group by all), k as (select count(*) as n from w where fit),
o as (select g, count(*) as df, sum(tf) as total from tf where fit group by g), kept as (select g, df, n from o, k where {keep} order by total desc, g {f"limit {most}" if most else ""}),
often as (select g, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 as idf, row_number() over (order by g) - 1 as i from kept),
x as (select doc_id, g, i, tf, df, tf * idf as w from tf join often using (g)), y as (select *, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from x)"""


WORD_GRAMS = "(select list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) from (select regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as w))"
CHAR_GRAMS = "(select list_concat([t[i:i + 1] for i in range(1, length(t))], [t[i:i + 2] for i in range(1, length(t) - 1)], [t[i:i + 3] for i in range(1, length(t) - 2)], [t[i:i + 4] for i in range(1, length(t) - 3)]) from (select regexp_replace(lower(text), '\\s\\s+', ' ', 'g') as t))"
FEATURE_SUMS = "count(*) as features, sum(tf)::BIGINT as grams, sum(df)::BIGINT as dfs, round(sum(weight), 6) as total, round(max(weight), 6) as most, round(sum(weight * (i % 1009)), 4) as placed"
#: Documents that classifiers learn from; the others are held out.
LEARN_SQL = f"label <> '' and {sql_number('doc_id', 33)} % 5 <> 0"


def learn():
    return (F.col("label") != "") & (F.pmod(number(F.col("doc_id"), 33), F.lit(5)) != 0)


def feature_sums(t):
    w = F.col("weight")
    return t.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("features"), F.sum("tf").alias("grams"), F.sum("df").alias("dfs"), F.round(F.sum(w), 6).alias("total"), F.round(F.max(w), 6).alias("most"), F.round(F.sum(w * (F.col("index") % 1009)), 4).alias("placed"))


@query("m1_tfidf_features", f"with {DOCS_SQL}, {tfidf_sql(WORD_GRAMS)} select doc_id, {FEATURE_SUMS} from y group by doc_id")
def m1(spark, sf):
    return feature_sums(X.tfidf_table(table(spark, sf, "documents"), "doc_id", X.word_ngrams(F.col("text")), spelled=False))


@query("m2_features", f"with {DOCS_SQL}, {tfidf_sql(CHAR_GRAMS, LEARN_SQL)} select doc_id, {FEATURE_SUMS} from y join docs using (doc_id) where label <> '' group by doc_id")
def m2_features(spark, sf):
    """The features that m2 trains and scores on: the dictionary of the learning rows, the weights of all labelled ones."""
    d = labelled(spark, sf).where("label <> ''")
    counts = X.gram_counts(d, "doc_id", X.char_ngrams(F.col("text")), learn())
    return feature_sums(X.weighted(counts, X.fit_dictionary(counts, d.where(learn()).count()), spelled=False))


LEGACY = (2, 0.8, 10_000)
LEGACY_KEEP = "df >= 2 and df <= 0.8::DOUBLE * n"


@query("m3_features", f"with {DOCS_SQL}, {tfidf_sql(WORD_GRAMS, LEARN_SQL, LEGACY_KEEP, 10_000)} select doc_id, {FEATURE_SUMS} from y join docs using (doc_id) where label <> '' group by doc_id")
def m3_features(spark, sf):
    d = labelled(spark, sf).where("label <> ''")
    counts = X.gram_counts(d, "doc_id", X.word_ngrams(F.col("text")), learn())
    return feature_sums(X.weighted(counts, X.fit_dictionary(counts, d.where(learn()).count(), *LEGACY), spelled=False))


def judged(spark, sf, train):
    """Every labelled document by a model that learned from those that aren't held out."""
    d = labelled(spark, sf).where("label <> ''")
    out = M.score_table(train(d.where(learn())), d, "text").withColumn("top", F.get(M.ranked(F.col("probs")), F.lit(0)))
    return out.select("doc_id", "label", (~learn()).alias("held_out"), F.col("top.label").alias("predicted"), F.round("top.p", 3).alias("p"))


@query("m2_train_score")
def m2(spark, sf):
    return judged(spark, sf, lambda d: M.train_classifier(d, "text", "label", "char", max_iter=40))


@query("m3_train_legacy")
def m3(spark, sf):
    return judged(spark, sf, lambda d: M.train_legacy(d, "text", "label"))


def predictions(spark, sf):
    top = D.top_class(F.col("probs"))
    df = probabilities(spark, sf).withColumn("top", top)
    return df.select("*", F.col("top.label").alias("top_label"), F.col("top.p").alias("top_p")).withColumn("predicted", M.apply_thresholds(F.col("top_label"), F.col("top_p"), F.col("p_normal")))


PRED_SQL = f"with {PROBS_SQL}, pr as (select *, case when top_label <> 'normal' and top_p >= case top_label when 'ad' then 0.25 when 'porn' then 0.25 when 'violence' then 0.55 else 0.65 end and top_p - p_normal >= 0.05 then top_label else 'normal' end as predicted from tops)"
PER_SQL = f", pc as (select label, (select count(*) from pr where true_label = label) as support, (select count(*) from pr where predicted = label) as called, (select count(*) from pr where predicted = label and true_label = label) as hits from (select unnest({sql_list(LABELS)}) as label)), pf as (select *, coalesce(hits / nullif(called, 0)::DOUBLE, 0) as p, coalesce(hits / nullif(support, 0)::DOUBLE, 0) as r, coalesce(2.0 * hits / nullif(called + support, 0), 0)::DOUBLE as f from pc)"


def _model_sql(name, column):
    of = f"(select count(*) from pr where true_label = label and {column} = label)"
    return f"select '{name}' as name, round(avg(coalesce(2.0 * {of} / nullif((select count(*) from pr where true_label = label) + (select count(*) from pr where {column} = label), 0), 0)), 9)::DOUBLE as macro_f1, round((select count(*) from pr where true_label = {column}) / (select count(*) from pr)::DOUBLE, 9) as accuracy from (select unnest({sql_list(LABELS)}) as label)"


@query("m4_select_model", f"{PRED_SQL}, models as ({_model_sql('argmax', 'top_label')} union all {_model_sql('gated', 'predicted')} union all {_model_sql('gated_again', 'predicted')}) select * from models order by macro_f1 desc, accuracy desc, name limit 1")
def m4(spark, sf):
    """Three ways to decide, the last equal to the second, by what they get right on all documents."""
    p = predictions(spark, sf)
    one = lambda name, column: M.classification_metrics(p, "true_label", column).select(F.lit(name).alias("name"), F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"))
    return M.select_model(one("argmax", "top_label").unionByName(one("gated", "predicted")).unionByName(one("gated_again", "predicted")))


def _gram_number(g: str, k: int) -> str:
    return f"(({sql_number(g, 1 + 4 * k)} - 32768) / 8192.0::DOUBLE)"


@query("m5_score_table", f"""with {DOCS_SQL}, {tfidf_sql(WORD_GRAMS, "true", LEGACY_KEEP, 10_000)},
s as (select doc_id, {", ".join(f"sum(weight * {_gram_number('g', k)}) as s{k}" for k in range(5))} from y group by doc_id),
m as (select d.doc_id, {", ".join(f"{k / 10} + coalesce(s{k}, 0) as m{k}" for k in range(5))} from docs d left join s using (doc_id)), e as (select *, exp(m0) + exp(m1) + exp(m2) + exp(m3) + exp(m4) as z from m),
p as (select doc_id, unnest([{", ".join(f"{{'label': '{c}', 'p': exp(m{k}) / z}}" for k, c in enumerate(sorted(CLASSES)))}], recursive := true) from e)
select doc_id, string_agg(label, '>' order by p desc, label) as ranked, round(max(p), 6) as top_p, round(sum(case when label = 'normal' then p end), 6) as normal_p from p group by doc_id""")
def m5(spark, sf):
    """Every document scored by a given model: coefficients of the legacy features from the n-grams' hashes."""
    d = table(spark, sf, "documents")
    words = X.fit_dictionary(X.gram_counts(d, "doc_id", X.word_ngrams(F.col("text"))), d.count(), *LEGACY)
    given = words.table.select("index", *(((number(F.col("gram"), 1 + 4 * k) - 32768) / F.lit(8192.0)).alias(f"c{k}") for k in range(5))).orderBy("index").collect()  # the model's size
    weights = np.array([[r[f"c{k}"] for r in given] for k in range(5)])
    out = M.score_table(M.TextModel("word", sorted(CLASSES), words, weights, np.arange(5) / 10), d.select("doc_id", "text"), "text").withColumn("ranked", M.ranked(F.col("probs")))
    normal = F.get(F.filter("probs", lambda x: x["label"] == "normal"), F.lit(0))["p"]
    return out.select("doc_id", F.array_join(F.transform("ranked", lambda x: x["label"]), ">").alias("ranked"), F.round(F.get("ranked", F.lit(0))["p"], 6).alias("top_p"), F.round(normal, 6).alias("normal_p"))


@query("m6_per_class_metrics", f"{PRED_SQL}{PER_SQL} select label, round(p, 9) as precision, round(r, 9) as recall, round(f, 9) as f1, support, called, hits from pf")
def m6(spark, sf):
    out = M.per_class_metrics(predictions(spark, sf), "true_label", "predicted")
    return out.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support", "called", "hits")


@query("m6_classification_metrics", f"{PRED_SQL}{PER_SQL} select (select count(*) from pr) as samples, round((select count(*) from pr where true_label = predicted) / (select count(*) from pr)::DOUBLE, 9) as accuracy, round(avg(p), 9) as macro_precision, round(avg(r), 9) as macro_recall, round(avg(f), 9) as macro_f1, round(sum(f * support) / sum(support), 9) as weighted_f1 from pf")
def m6b(spark, sf):
    out = M.classification_metrics(predictions(spark, sf), "true_label", "predicted")
    return out.select("samples", *(F.round(c, 9).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")))


@query("m7_confusion_matrix", f"{PRED_SQL} select l as actual, " + ", ".join(f"count(*) filter (predicted = '{c}') as {c}" for c in LABELS) + f" from (select unnest({sql_list(LABELS)}) as l) left join pr on true_label = l group by l")
def m7(spark, sf):
    return M.confusion_matrix(predictions(spark, sf), "true_label", "predicted")


@query("m8_risk_rates", f"{PRED_SQL} select round(count(*) filter (true_label = 'normal' and predicted <> 'normal') / nullif(count(*) filter (true_label = 'normal'), 0)::DOUBLE, 9) as normal_fpr, round(count(*) filter (true_label <> 'normal' and predicted <> 'normal') / count(*) filter (true_label <> 'normal')::DOUBLE, 9) as risk_recall_any, round(count(*) filter (true_label <> 'normal' and predicted = true_label) / count(*) filter (true_label <> 'normal')::DOUBLE, 9) as risk_recall_same from pr")
def m8(spark, sf):
    out = M.classification_metrics(predictions(spark, sf), "true_label", "predicted")
    return out.select(*(F.round(c, 9).alias(c) for c in ("normal_fpr", "risk_recall_any", "risk_recall_same")))


@query("m9_action_metrics", f"with s as (select {sql_list(['pass', 'sanitize', 'block'])}[({sql_number('event_id', 1)} % 3) + 1] as e, {sql_list(['pass', 'sanitize', 'block'])}[({sql_number('event_id', 5)} % 3) + 1] as a from events) select round(count(*) filter (e = a) / count(*)::DOUBLE, 9) as action_accuracy, round(count(*) filter (e = 'block' and a = 'block') / count(*) filter (e = 'block')::DOUBLE, 9) as block_recall, round(count(*) filter (e = 'sanitize' and a = 'sanitize') / count(*) filter (e = 'sanitize')::DOUBLE, 9) as sanitize_recall from s")
def m9(spark, sf):
    pick = lambda at: F.get(F.array(*map(F.lit, ("pass", "sanitize", "block"))), F.pmod(number(F.col("event_id"), at), F.lit(3)).cast("int"))
    df = table(spark, sf, "events").select(pick(1).alias("e"), pick(5).alias("a"))
    return M.action_metrics(df, "e", "a").select(*(F.round(c, 9).alias(c) for c in ("action_accuracy", "block_recall", "sanitize_recall")))


def _modes_sql():
    from textmill.plans.text_queries import FOUND_SQL, SEMANTIC_SQL

    return f"""{SEMANTIC_SQL}, {FOUND_SQL}, al as (select doc_id, category, source, score, true as rule from found union all select doc_id, category, 'semantic_ml', score, false from scored),
md as (select unnest(['rule_only', 'semantic_only', 'combined']) as mode), k as (select mode, doc_id, category, score, row_number() over (partition by mode, doc_id order by score desc, category, source) as place from md join al on mode = 'combined' or (mode = 'rule_only') = rule)
select mode, true_label, coalesce(category, 'normal') as predicted, case when score >= 80 then 'block' when score >= 40 then 'sanitize' else 'pass' end as action, count(*) as n from (select mode, doc_id, true_label from md, probs) left join (select * from k where place = 1) using (mode, doc_id) group by all"""


@query("m10_evaluate_modes", _modes_sql())
def m10(spark, sf):
    sem = probabilities(spark, sf).select("doc_id", "true_label", D.semantic_detection(D.semantic_gate(F.col("probs"))).alias("semantic"))
    df = rule_rows(spark, sf).select("doc_id", F.col("detections").alias("rule")).join(sem, "doc_id")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), M.mode_verdict(F.col("rule"), F.col("semantic"), m).alias("v")) for m in ("rule_only", "semantic_only", "combined")])
    return df.select("true_label", F.explode(modes).alias("m")).groupBy("m.mode", "true_label", "m.v.label", "m.v.action").agg(F.count("*").alias("n")).toDF("mode", "true_label", "predicted", "action", "n")


@query("m11_apply_thresholds", f"{PRED_SQL} select predicted, count(*) as n from pr group by predicted")
def m11(spark, sf):
    return predictions(spark, sf).groupBy("predicted").agg(F.count("*").alias("n"))


@query("m12_legacy_fallback", f"with {PROBS_SQL}, u as (select doc_id, unnest([{', '.join('{' + chr(39) + 'i' + chr(39) + f': {i}, ' + chr(39) + 'l' + chr(39) + f': {chr(39)}{c}{chr(39)}, ' + chr(39) + 'p' + chr(39) + f': p_{c}' + '}' for i, c in enumerate(CLASSES))}]) as x from probs), k as (select doc_id, x.l as l, x.p as p, row_number() over (partition by doc_id order by x.p desc, x.i) as n from u), w as (select a.doc_id, a.l as l1, a.p as p1, b.l as l2, b.p as p2 from k a join k b on a.doc_id = b.doc_id and a.n = 1 and b.n = 2) select case when p1 < 0.15 then 'normal' when l1 <> 'normal' then l1 when p1 < 0.6 and l2 <> 'normal' and p2 > 0.15 then l2 else 'normal' end as predicted, count(*) as n from w group by 1")
def m12(spark, sf):
    ranked = F.array_sort("probs", lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
    return probabilities(spark, sf).groupBy(M.legacy_fallback(ranked).alias("predicted")).agg(F.count("*").alias("n"))


M13 = f"""with {PROBS_SQL}, cells as (select top_label as top, true_label as true_, {' + '.join(f'(top_p >= {g})::INT' for g in M.GRID)} as t, {' + '.join(f'(top_p - p_normal >= {m})::INT' for m in M.MARGINS)} as m, count(*) as n from tops group by all),
st as (select i as ti, {list(M.GRID)}[i + 1] as threshold, j as mi, {list(M.MARGINS)}[j + 1] as margin from range(0, 11) a(i), range(0, 6) b(j)),
per as (select l as label, ti, threshold, mi, margin, coalesce(sum(n) filter (true_ = l), 0) as hits, coalesce(sum(n), 0) as called, coalesce(sum(n) filter (true_ = 'normal'), 0) as fp from st cross join (select unnest(['ad','porn','violence','sensitive']) as l) left join cells on top = l and t > ti and m > mi group by all),
tot as (select true_label, count(*) as n from probs group by 1),
s as (select p.*, coalesce(2.0::DOUBLE * hits / nullif(called + tot.n, 0), 0) as f, abs(threshold - case label when 'violence' then 0.55 when 'sensitive' then 0.65 else 0.25 end) as off from per p join tot on tot.true_label = label),
x as (select a.margin, a.threshold as threshold_ad, b.threshold as threshold_porn, c.threshold as threshold_violence, d.threshold as threshold_sensitive, a.hits + b.hits + c.hits + d.hits as hits, a.called + b.called + c.called + d.called as called, a.fp + b.fp + c.fp + d.fp as fp, a.f + b.f + c.f + d.f as f, a.off + b.off + c.off + d.off as off from s a join s b on a.mi = b.mi and a.label = 'ad' and b.label = 'porn' join s c on c.mi = a.mi and c.label = 'violence' join s d on d.mi = a.mi and d.label = 'sensitive'),
k as (select (select count(*) from probs) as n_all, (select count(*) from probs where true_label = 'normal') as n_normal),
y as (select *, (coalesce(2.0::DOUBLE * (n_normal - fp) / nullif(n_all - called + n_normal, 0), 0) + f) / 5 as macro_f1, (hits + n_normal - fp) / n_all::DOUBLE as accuracy, fp / n_normal::DOUBLE as normal_fpr, hits / (n_all - n_normal)::DOUBLE as risk_recall from x, k)"""


@query("m13_calibrate_grid", f"{M13} select threshold_ad::DOUBLE as threshold_ad, threshold_porn::DOUBLE as threshold_porn, threshold_violence::DOUBLE as threshold_violence, threshold_sensitive::DOUBLE as threshold_sensitive, margin::DOUBLE as margin, round(macro_f1, 9) as macro_f1, round(accuracy, 9) as accuracy, (select count(*) from y) as evaluated, (select count(*) from y where normal_fpr <= 0.1) as feasible from y where normal_fpr <= 0.1 order by round(macro_f1, 12) desc, round(accuracy, 12) desc, normal_fpr, risk_recall desc, round(off, 9), margin, threshold_ad, threshold_porn, threshold_violence, threshold_sensitive limit 1")
def m13(spark, sf):
    out = M.calibrate_grid(predictions(spark, sf), "true_label", "top_label", "top_p", "p_normal")
    return out.select(*(F.col(f"threshold_{c}").cast("double").alias(f"threshold_{c}") for c in ("ad", "porn", "violence", "sensitive")), F.col("margin").cast("double").alias("margin"), F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"), "evaluated", "feasible")


@query("m14_load_partition", f"select lang as label, count(*) as rows from documents where {SPLIT_SQL} = 'test' group by lang")
def m14(spark, sf):
    d = split_docs(spark, sf).withColumn("review_status", F.lit("verified"))
    return M.load_partition(d, "test", "split", label="lang", labels=("en", "de", "fr", "es")).groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("rows"))


SAFE_REPLY = "of course"


def _cases_sql():
    from textmill.plans import text_sql as Q

    return f"""with w0 as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as r, lead(text) over (partition by conv_id order by turn) as x from conversations where role <> 'system'),
t0 as (select conv_id, turn, text as message, coalesce(case when r = 'assistant' then x end, '{SAFE_REPLY}') as reply, conv_id || '-' || turn as key, case when turn % 4 = 0 then 'block' else 'pass' end as expected_action, case when turn % 3 = 0 then 'ad' else 'normal' end as expected_category from w0 where role = 'user'),
{Q.verdict('t0', 'message', 'key')},
t1 as (select t0.*, v.action as in_action, risk_categories as in_cats, case when v.action <> 'block' then reply end as heard from t0 join v using (key)),
{Q.guarded('t1', 'heard', 'key')},
low as (select key, lower(message) as low from t0), {Q.found('low', 'low', 'fb', 'key')}, base as (select key, coalesce(max(score), 0) as score from t0 left join fb using (key) group by key),
c as (select t1.conv_id, t1.turn, t1.expected_action, t1.expected_category, t1.in_action, t1.in_cats, gg.action as out_action, case when score >= 80 then 'block' when score >= 40 then 'sanitize' else 'pass' end as baseline_action from t1 join base using (key) left join gg using (key))
select conv_id, turn, in_action, out_action, baseline_action, baseline_action = 'pass' and in_action <> 'pass' as baseline_missed, expected_action = in_action as action_matches, out_action is not distinct from 'pass' as output_matches,
 list_contains(string_split(in_cats, ','), expected_category) or (in_cats = '' and expected_category = 'normal') as category_matches, baseline_action = 'pass' as baseline_matches from c"""


@query("m15_case_regression", _cases_sql())
def m15(spark, sf):
    from textmill.functions import decide as R
    from textmill.plans.base import PACK

    turn = F.col("turn")
    cases = R.turn_pairs(table(spark, sf, "conversations")).withColumns({
        "expected_action": F.when(turn % 4 == 0, "block").otherwise("pass"), "expected_category": F.when(turn % 3 == 0, "ad").otherwise("normal"), "expected_output_action": F.lit("pass"), "expected_baseline": F.lit("pass"),
    })
    baseline = R.action_of(R.risk_score(D.detect_rules(F.lower("message"), PACK)))
    out = M.case_regression(cases, lambda df: R.moderate_turns(df, PACK), baseline, SAFE_REPLY, expected_category="expected_category", expected_baseline="expected_baseline")
    return out.select("conv_id", "turn", "in_action", "out_action", "baseline_action", "baseline_missed", "action_matches", "output_matches", "category_matches", "baseline_matches")


@query("m16_case_metrics", f"with s as (select {sql_list(['pass', 'sanitize', 'block'])}[({sql_number('event_id', 1)} % 3) + 1] as e, {sql_list(['pass', 'sanitize', 'block'])}[({sql_number('event_id', 5)} % 3) + 1] as a, event_id % 3 = 0 as demo from events), r as (select * from s where not demo) select count(*) as cases, round(count(*) filter (e = a) / count(*)::DOUBLE, 9) as action_match, round(count(*) filter (a = a) / count(*)::DOUBLE, 9) as output_match, round(count(*) filter (e <> 'pass' and a <> 'pass') / count(*) filter (e <> 'pass')::DOUBLE, 9) as risk_match, count(*) filter (e = 'block') as baseline_missed from r")
def m16(spark, sf):
    pick = lambda at: F.get(F.array(*map(F.lit, ("pass", "sanitize", "block"))), F.pmod(number(F.col("event_id"), at), F.lit(3)).cast("int"))
    df = table(spark, sf, "events").select(pick(1).alias("expected_action"), pick(5).alias("in_action"), (F.col("event_id") % 3 == 0).alias("demo_only"))
    df = df.withColumn("expected_output_action", F.col("in_action")).withColumn("out_action", F.col("in_action")).withColumn("baseline_missed", F.col("expected_action") == "block")
    return M.case_metrics(df).select("cases", *(F.round(c, 9).alias(c) for c in ("action_match", "output_match", "risk_match")), "baseline_missed")


# ---- sources and sinks


@query("s1_read_lexicon", "with w as (select distinct source, unnest(string_split(lower(text), ' ')) as w from documents), k as (select source, w, row_number() over (partition by source order by w) as pos from w where length(w) between 3 and 8 and regexp_matches(w, '^[a-z]+$')) select source as category, count(*) as words, sum(pos)::BIGINT as places, md5(string_agg(w, ' ' order by pos)) as md5 from k group by source")
def s1(spark, sf):
    """Each source's words in a file named after it, read as a lexicon."""
    words = table(spark, sf, "documents").select("source", F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word rlike '^[a-z]{3,8}$'").distinct()
    path = place(spark, "lexicon")
    line_files(words, ["source"], "word", "word", path)
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, "source=*")):  # a file a source
        name = folder.getPath().getName().partition("=")[2]
        for part in fs.listStatus(folder.getPath()):
            fs.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(top, f"{name}.txt"))
    rows = S.read_lexicon(spark, f"{path}/*.txt")
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return rows.groupBy("category").agg(F.count("*").alias("words"), F.sum("pos").alias("places"), F.md5(in_order).alias("md5"))


@query("s2_read_regex_rules", "select event_type as category, count(distinct user_id)::BIGINT as rules from events where user_id % 7 <> 0 group by event_type")
def s2(spark, sf):
    bad = F.col("user_id") % 7 == 0
    rules = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("category"), F.when(bad, "(").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("pattern")).distinct()
    path = place(spark, "rules")
    # a rule file is one small array: the rules of ten users
    one = rules.groupBy(F.expr("cast(name as bigint) div 10").alias("b")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    one.repartition("b").write.partitionBy("b").text(path)
    return S.read_regex_rules(spark, path).groupBy("category").agg(F.count("*").alias("rules"))


@query("s3_read_map", "select count(distinct user_id)::BIGINT as entries, count(distinct user_id) filter (user_id % 2 = 0)::BIGINT as plain from events")
def s3(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    value = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('"t'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('{"target":"t'), F.col("user_id").cast("string"), F.lit('","confidence":0.9}')))
    path = place(spark, "map")
    # a map file is one small object: the entries of a hundred users
    one = users.select(F.expr("user_id div 100").alias("b"), F.concat(F.lit('"'), key, F.lit('":'), value).alias("e")).groupBy("b").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("e")), ","), F.lit("}")).alias("value"))
    one.repartition("b").write.partitionBy("b").text(path)
    return S.read_map(spark, path).agg(F.count("*").alias("entries"), F.count_if(F.col("confidence").isNull()).alias("plain"))


@query("s4_merge_maps", "select count(*) as entries, count(*) filter (t = 'b') as overridden from (select coalesce(b.source, a.source) as s, case when b.source is not null then 'b' else 'a' end as t from (select distinct source from documents) a full join (select distinct source from documents where lang = 'de') b on a.source = b.source)")
def s4(spark, sf):
    d = table(spark, sf, "documents")
    maps = [d.select("source", F.lit("a").alias("target")).distinct(), d.where("lang = 'de'").select("source", F.lit("b").alias("target")).distinct()]
    return S.merge_maps(maps).agg(F.count("*").alias("entries"), F.count_if(F.col("target") == "b").alias("overridden"))


@query("s5_read_labelled_lines", "with l as (select lang, doc_id, doc_id // 1000 as b, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where lang in ('en', 'de')), n as (select lang, b, regexp_replace(l, '^\\s+|\\s+$', '', 'g') as t, row_number() over (partition by lang, b order by doc_id, k) as line from l) select lang as label, count(*) as lines, sum(line)::BIGINT as places, sum(line * length(t))::BIGINT as placed from n where t <> '' and not starts_with(t, '#') group by lang")
def s5(spark, sf):
    path = place(spark, "lines")
    line_files(table(spark, sf, "documents").withColumn("b", F.expr("doc_id div 1000")), ["lang", "b"], "doc_id", "text", path)
    rows = S.read_labelled_lines(spark, {"en": f"{path}/lang=en", "de": f"{path}/lang=de"})
    return rows.groupBy("label").agg(F.count("*").alias("lines"), F.sum("source_line").alias("places"), F.sum(F.col("source_line") * F.length("text")).alias("placed"))


@query("s6_read_table_csv", "select lang, count(*) as rows, count(distinct text) as texts from documents group by lang")
def s6(spark, sf):
    path = place(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.csv(path, header=True, escape='"')
    return S.read_table_csv(spark, path, ["doc_id", "text"]).groupBy("lang").agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts"))


@query("s7_read_events", "select event_type, count(*) as events from events where event_id % 10 <> 0 and ts >= timestamp '2024-01-05' group by event_type")
def s7(spark, sf):
    path = place(spark, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), "event_type")))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return S.read_events(spark, path, "time string, event_type string", F.lit("2024-01-05").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("events"))


@query("s8_reference_union", "select reference_file, count(*) as rows from (select 'documents' as reference_file, doc_id::varchar, text from documents where text <> '' union select 'documents', doc_id::varchar, lower(text) from documents where text <> '' union select 'benchmark', item_id::varchar, text from benchmark where text <> '') group by 1")
def s8(spark, sf):
    d = table(spark, sf, "documents").withColumn("adversarial_text", F.lower("text"))
    return S.reference_union({"documents": (d, "doc_id", "lang", ("text", "adversarial_text")), "benchmark": (table(spark, sf, "benchmark"), "item_id", None, ("text",))}).groupBy("reference_file").agg(F.count("*").alias("rows"))


@query("s9_sample_union", "select 'documents' as source, 'test' as set_type, count(*) as rows from documents where text <> '' union all select 'benchmark', 'evaluation', count(*) from benchmark where text <> ''")
def s9(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("label", F.lit("")).withColumn("empty", F.lit(""))
    return S.sample_union({"documents": (table(spark, sf, "documents"), "doc_id", "lang", ("text",), "test"), "benchmark": (b, "item_id", "label", ("empty", "text"), "evaluation")}).groupBy("source", "set_type").agg(F.count("*").alias("rows"))


def _turns_sql(rest):
    from textmill.plans.text_queries import EVENT_ROWS_SQL

    return f"{EVENT_ROWS_SQL} {rest}"


@query("s10_write_events", _turns_sql("select event_stage, case when event_stage = 'input' then '[REDACTED]' end as input, count(*) as events from ev group by all"))
def s10(spark, sf):
    path = place(spark, "log")
    S.write_events(turn_events(spark, sf).drop("time"), path)
    return spark.read.json(path).groupBy("event_stage", "input").agg(F.count("*").alias("events"))


@query("s11_write_report", "select lang, count(*) as rows from documents group by lang")
def s11(spark, sf):
    path = place(spark, "report")
    S.write_report(table(spark, sf, "documents").select("doc_id", "lang", "source"), path, ["doc_id", "lang", "absent"], ["doc_id"])
    return spark.read.csv(path, header=True).groupBy("lang").agg(F.count("*").alias("rows"))


@query("s12_label_catalog_rows", "with l as (select lang as label, source as scenario, md5(text) as t, row_number() over (partition by lang, source order by md5(text)) - 1 as pos from (select distinct lang, source, text from documents)) select label, case when pos < 10 then 'medium' else 'high' end as risk_level, count(*) as rows, count(distinct substr(sha256(label || chr(31) || t), 1, 16)) as ids from l group by all")
def s12(spark, sf):
    texts = S.catalog_places(table(spark, sf, "documents").select("lang", "source", F.md5("text").alias("t")), "lang", "source", "t")
    return S.label_catalog_rows(texts, "catalog").groupBy("label", "risk_level").agg(F.count("*").alias("rows"), F.count_distinct("sample_id").alias("ids"))


@query("s13_map_entries", "select case when user_id % 10 >= 9 then 'high' when user_id % 10 >= 8 then 'medium' else 'low' end as confidence_level, count(distinct user_id)::BIGINT as entries from events group by 1")
def s13(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.lit("t").alias("target"), ((F.col("user_id") % 10) / 10).cast("string").alias("confidence")).distinct()
    e = e.select("*", *(F.lit(None).cast("string").alias(c) for c in ("type", "confidence_score", "rationale")))
    return S.map_entries(e).groupBy("confidence_level").agg(F.count("*").alias("entries"))


@query("s14_rule_listing", "select 'regex' as kind, event_type as category, count(distinct user_id)::BIGINT as n from events group by event_type union all select 'word', source, count(distinct lang)::BIGINT from documents group by source")
def s14(spark, sf):
    words = table(spark, sf, "documents").select(F.col("source").alias("category"), F.col("lang").alias("word")).distinct()
    rules = table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("pattern")).distinct()
    return S.rule_listing(words, rules).groupBy("kind", "category").agg(F.count("*").alias("n"))


# ---- streams


def run_stream(df, name: str, mode: str = "append"):
    """The stream run to the end of its input, as a table."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def as_stream(df, name: str):
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("t1_moderate_stream", _turns_sql("select in_action, out_action, allowed, count(*) as turns from tt group by all"))
def t1(spark, sf):
    from textmill.functions.decide import turn_pairs
    from textmill.plans.base import PACK

    pairs = as_stream(turn_pairs(table(spark, sf, "conversations")), "turns")
    out = run_stream(T.moderate_stream(pairs, PACK).select("conv_id", "turn", "in_action", "out_action", "allowed"), "moderated")
    return out.groupBy("in_action", "out_action", "allowed").agg(F.count("*").alias("turns"))


def in_batches(df, name: str, part, batches: int):
    """df as a stream of so many micro-batches, rows dealt in order of the number `part`."""
    path = place(df.sparkSession, name)
    for b in range(batches):
        df.where(part == b).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("t1_turn_pairs_stream", "with w as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as r, lead(text) over (partition by conv_id order by turn) as t from conversations where role <> 'system') select conv_id, turn, md5(text) as message, case when r = 'assistant' then md5(t) end as reply from w where role = 'user'")
def t1_pairs(spark, sf):
    """Conversations split over micro-batches turn by turn; a last row far ahead in time lets every turn that waits time out."""
    time = F.timestamp_micros((F.col("turn") * 3600 + 86_400 + F.pmod(F.col("conv_id"), F.lit(3600))) * 1_000_000)
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", time.alias("time"), F.least(F.col("turn"), F.lit(3)).alias("part"))
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit("").alias("text"), F.timestamp_micros(F.lit(4_000_000_000_000_000)).alias("time"), F.lit(4).cast("long").alias("part"))
    stream = in_batches(c.unionByName(clock), "turns", F.col("part"), 5)
    with keyed_state(spark):
        out = run_stream(turn_pairs_stream(stream, wait="1000 days", late="1 hour"), "pairs")
    return out.select("conv_id", "turn", F.md5("message").alias("message"), F.md5("reply").alias("reply"))


def kept_cells(spark, sf):
    """The cell table of all events, which come in six micro-batches, added up after three."""
    path = place(spark, "cells")
    cells = CellTable(spark, path, compact=3)
    stream = in_batches(derived_events(spark, sf), "in", F.pmod(F.col("event_id"), F.lit(6)), 6)
    cells.writer(stream, f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return cells.cells()


SINCE = "2024-01-10 07:30:11"


@query("t2_stats_from_cells", f"with {EVENTS_SQL} select (select count(*) from e where ts >= timestamp '{SINCE}') as total_events, {STATS} from r where ts >= timestamp '{SINCE}'")
def t2_stats(spark, sf):
    return K.stats(K.since(kept_cells(spark, sf), F.lit(SINCE).cast("timestamp"), derived_events(spark, sf)))


@query("t2_counts_from_cells", f"with {EVENTS_SQL}, l as ({LONG}) select dimension, name, count(*) as count from l group by all")
def t2_counts(spark, sf):
    return K.counts(kept_cells(spark, sf))


@query("t2_event_counts_stream", f"with {EVENTS_SQL} select date_trunc('day', ts)::TIMESTAMP as window_start, stage, count(*) as results, count(*) filter (action = 'block') as blocked, count(*) filter (action = 'sanitize') as rewritten, sum(rule_hits)::BIGINT as rule_hits, sum(semantic_hits)::BIGINT as semantic_hits from r where ts is not null group by all")
def t2(spark, sf):
    counts = T.event_counts_stream(as_stream(derived_events(spark, sf), "events"), window="1 day")
    path = place(spark, "counts")
    q = T.keyed_sink(counts, path, f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return T.latest(spark, path, counts.schema, ("window_start", "stage"))


@query("t3_since_stream", "select event_type, count(*) as events from events where ts >= timestamp '2024-01-10' group by event_type")
def t3(spark, sf):
    out = run_stream(T.since_stream(as_stream(table(spark, sf, "events"), "raw"), F.lit("2024-01-10").cast("timestamp"), "ts").select("event_type", "event_id"), "since")
    return out.groupBy("event_type").agg(F.count("*").alias("events"))


@query("t4_redacted_event_sink", "select '[REDACTED]' as input, count(*) as events from events")
def t4(spark, sf):
    path = place(spark, "sink")
    q = T.redacted_sink(as_stream(derived_events(spark, sf), "in"), path, f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.json(path).groupBy("input").agg(F.count("*").alias("events"))


