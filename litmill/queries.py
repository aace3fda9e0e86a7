"""The queries of the core operators: name -> query, and SQL for the same rows where SQL can express them at bearable cost."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import keys, labels, people
from litmill.operators import filters, graph, lift, merge, ranking
from litmill.operators.packed import split_packed
from litmill.plans import stages
from litmill.streaming import log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _literature(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "merged_literature")


def _lambdas(sql: str) -> str:
    """SQL with lambdas written as ``x -> ...`` in the form that DuckDB keeps."""
    return re.sub(r"(?<![\w-])(\w+) -> ", r"lambda \1: ", re.sub(r"\((\w+), (\w+)\) -> ", r"lambda \1, \2: ", sql))


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = _lambdas(sql)
        return run

    return register


@query(
    r"""with v as (select rec_id, 'doc_type' as field_name, doc_type as v from merged_literature union all select rec_id, 'source', source from merged_literature union all select rec_id, 'uid', uid from merged_literature),
b as (select *, regexp_replace(case when regexp_matches(v, '(?s)^\s*\[.*\]\s*$') then regexp_extract(v, '(?s)^\s*\[(.*)\]\s*$', 1) else v end, '\s/\s', ';', 'g') as body from v where v is not null),
t as (select rec_id, field_name, list_transform(regexp_extract_all(body, '\s*"(?:[^"\\]|\\.|"")*"\s*|[^;；,，|｜\t\n\r]+'), x -> regexp_replace(x, '^\s+|\s+$', '', 'g')) as parts from b),
c as (select rec_id, field_name, list_filter(list_transform(parts, x -> case when x like '"%"' and length(x) > 1 then replace(replace(substr(x, 2, length(x) - 2), '""', '"'), '\"', '"') else x end), x -> x <> '') as items from t)
select rec_id, field_name, i::int as item_pos, items[i] as item from (select *, unnest(generate_series(1, len(items))) as i from c where len(items) >= 2)"""
)
def p3_found(spark, folder):
    """Every value of the fields of merged_literature that pack two or more, in order."""
    return split_packed(_literature(spark, folder), "rec_id", ["doc_type", "source", "uid"], min_items=2)


# --- normal forms -----------------------------------------------------------------------------------------------------

_DOI = r"regexp_replace(regexp_extract(lower(regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')), '10\.\S+', 0), '[.)]+$', '')"
_TITLE = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_LETTERS = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"


@query(f"select rec_id, {_DOI.format('doi')} as doi_key, regexp_replace(lower(regexp_replace(coalesce(doi, ''), '^\\s+|\\s+$', '', 'g')), '^https?://doi\\.org/', '') as doi_bare, lower(regexp_replace(coalesce(doi, ''), '^\\s+|\\s+$', '', 'g')) as doi_lower from merged_literature")
def f_doi_keys(spark, folder):
    """The three normal forms of a DOI."""
    d = F.col("doi")
    return _literature(spark, folder).select("rec_id", keys.doi_key(d).alias("doi_key"), keys.doi_without_resolver(d).alias("doi_bare"), keys.lowered(d).alias("doi_lower"))


@query(f"select rec_id, {_TITLE.format('title')} as words_key, {_LETTERS.format('title')} as letters_key, lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')) as light_key from merged_literature")
def f_title_keys(spark, folder):
    """The three normal forms of a title."""
    t = F.col("title")
    return _literature(spark, folder).select("rec_id", keys.title_words_key(t).alias("words_key"), keys.title_letters_key(t).alias("letters_key"), keys.lowered(t).alias("light_key"))


@query(r"""select rec_id, trim(regexp_replace(replace(coalesce(abstract, ''), chr(0), ' '), '\s+', ' ', 'g')) as abstract_clean,
  coalesce(title, '') || ' ' || coalesce(abstract, '') as text,
  case when length(coalesce(abstract, '')) > 200 then substr(abstract, 1, 200) || ' [...]' else coalesce(abstract, '') end as abstract_short from merged_literature""")
def f_text_forms(spark, folder):
    """Collapsed, joined and shortened texts."""
    a = F.col("abstract")
    return _literature(spark, folder).select("rec_id", keys.collapsed(a).alias("abstract_clean"), keys.title_and_abstract(F.col("title"), a).alias("text"), keys.shortened(a, 200).alias("abstract_short"))


@query(r"""select rec_id, coalesce(nullif(regexp_replace(coalesce(journal, ''), '^\s+|\s+$', '', 'g'), ''), regexp_replace(coalesce(venue, ''), '^\s+|\s+$', '', 'g')) as venue_name,
  lower(trim(regexp_replace(coalesce(journal, ''), '\s+', ' ', 'g'))) as venue_key, try_cast(regexp_replace(coalesce(year, ''), '^\s+|\s+$', '', 'g') as double) as year_num from merged_literature""")
def f_venue_and_year(spark, folder):
    """Venue with its fallback, and the year as a number."""
    year = keys.number(F.col("year"))
    return _literature(spark, folder).select("rec_id", keys.venue_name(F.col("journal"), F.col("venue")).alias("venue_name"), keys.venue_key(F.col("journal")).alias("venue_key"), year.alias("year_num"))


_PARTS = "list_filter(list_transform(string_split(coalesce({0}, ''), ';'), x -> trim(x)), x -> x <> '')"


@query(f"""with a as (select rec_id, {_PARTS.format('authors')} as names from merged_literature)
select rec_id, len(names) as n_names, array_to_string(list_distinct_ordered, '; ') as joined, surnames from (
  select rec_id, names, list_filter(names, (x, i) -> list_position(names, x) = i) as list_distinct_ordered,
    array_to_string(list_sort(list_distinct(list_transform(names, x -> lower(case when contains(x, ',') then trim(string_split(x, ',')[1]) else regexp_extract(x, '(\\S+)$', 1) end)))), '|') as surnames from a)""")
def f_author_lists(spark, folder):
    """Names of the author field: how many, joined without repeats, and the set of surnames."""
    names = people.split_authors(F.col("authors"))
    return _literature(spark, folder).select("rec_id", F.size(names).cast("bigint").alias("n_names"), people.join_authors(names).alias("joined"), F.array_join(F.array_sort(people.surnames(names)), "|").alias("surnames"))


@query()
def f_split_names(spark, folder):
    """First and last name of every author of the author field."""
    names = _literature(spark, folder).select("rec_id", F.posexplode(people.split_authors(F.col("authors"))).alias("pos", "name"))
    return names.withColumn("n", people.split_name(F.col("name"))).select("rec_id", (F.col("pos") + 1).alias("position"), F.col("n.first").alias("first_name"), F.col("n.last").alias("last_name"))


_JSON = "case when json_valid({0}) and json_type({0}) = 'ARRAY' then from_json({0}, '[\"VARCHAR\"]') else [] end"


@query(f"select rec_id, u.i as position, k[u.i] as keyword from (select rec_id, {_JSON.format('keywords')} as k from merged_literature), lateral (select unnest(generate_series(1, len(k))) as i) u")
def f_keywords(spark, folder):
    """Keywords of the JSON field, with their place."""
    rows = _literature(spark, folder).select("rec_id", F.posexplode(people.json_list(F.col("keywords"))).alias("p", "keyword"))
    return rows.select("rec_id", (F.col("p") + 1).cast("bigint").alias("position"), "keyword")


@query("""select rec_id, len(authors_list) as n_authors, first_author, corresponding, has_orcid, array_to_string(countries, '|') as countries, array_to_string(institutions, '|') as institutions, name_key from master""")
def f_people(spark, folder):
    """Author metadata made anew from the nested text, against the columns delivered."""
    done = stages.normalise(table(spark, folder, "master"))
    return done.select("rec_id", F.col("n_authors").cast("bigint").alias("n_authors"), "first_author", "corresponding", "has_orcid", F.array_join("countries", "|").alias("countries"), F.array_join("institutions", "|").alias("institutions"), "name_key")


@query()
def f_labels_of_names(spark, folder):
    """ASCII and abbreviated forms of the first author's name, for labels."""
    last_first = F.lower(F.regexp_replace("first_author", r"^(.*)\s(\S+)$", "$2 $1"))
    return table(spark, folder, "master").where("first_author <> ''").select("rec_id", people.ascii_label("first_author").alias("ascii_name"), people.abbreviated(people.ascii_label(last_first)).alias("label"))


@query("select rec_id, venue_name, year_num, array_to_string(keywords_list, '|') as keywords, array_to_string(mesh_list, '|') as mesh from master")
def f_normalised(spark, folder):
    """The other columns of the normalising stage, against those delivered."""
    done = stages.normalise(table(spark, folder, "master"))
    return done.select("rec_id", "venue_name", "year_num", F.array_join("keywords_list", "|").alias("keywords"), F.array_join("mesh_list", "|").alias("mesh"))


@query("""with t as (select rec_id, list_filter(list_transform(regexp_split_to_array(coalesce(doc_type, ''), '[;,]'), x -> trim(x)), x -> x <> '') as p from merged_literature)
select rec_id, case when len(p) = 0 then 'unknown'
  when len(list_filter(p, x -> regexp_matches(lower(x), '^retract'))) > 0 then 'retraction'
  when len(list_filter(p, x -> regexp_matches(lower(x), '^(phdthesis|mastersthesis|thesis)$'))) > 0 then 'thesis'
  when len(list_filter(p, x -> regexp_matches(lower(x), '^(book|booklet|incollection)$'))) > 0 then 'book'
  when len(list_filter(p, x -> regexp_matches(lower(x), '^(inproceedings|proceedings|conference)'))) > 0 then 'proceedings'
  when len(list_filter(p, x -> regexp_matches(lower(x), '^(editorial|letter|comment|note|erratum|correction)'))) > 0 then 'editorial'
  when len(list_filter(p, x -> regexp_matches(lower(x), '^(review|survey)'))) > 0 then 'review'
  when len(list_filter(p, x -> regexp_matches(lower(x), '^(article|journal article|data paper|early access|meeting)'))) > 0 then 'article'
  else 'other' end as doc_type_std from t""")
def f_doc_types(spark, folder):
    """The document type by ordered rules."""
    return _literature(spark, folder).select("rec_id", labels.doc_type(F.col("doc_type")).alias("doc_type_std"))


_CODE = """case when try_cast(regexp_extract(upper(trim({0})), '^{1}?0*(\\d+)$', 1) as int) between 1 and {2} then '{1}' || lpad(cast(try_cast(regexp_extract(upper(trim({0})), '^{1}?0*(\\d+)$', 1) as int) as varchar), 2, '0') end"""


@query(f"select row_index, logged_at, received_at, {_CODE.format('topic', 'T', 32)} as topic_code, {_CODE.format('agent', 'A', 15)} as agent_code, {_CODE.format('llm_role', 'L', 20)} as role_code from label_log")
def f_codes(spark, folder):
    """Codes of the log in one form, null where they are none."""
    rows = table(spark, folder, "label_log")
    return rows.select("row_index", "logged_at", "received_at", labels.code(F.col("topic"), "T", 32).alias("topic_code"), labels.code(F.col("agent"), "A", 15).alias("agent_code"), labels.code(F.col("llm_role"), "L", 20).alias("role_code"))


@query()
def f_entities(spark, folder):
    """Entities named in the agents' label, and the canonical domain of the topic's label."""
    rows = table(spark, folder, "master").where("abm_topic_label is not null").select("rec_id", "abm_topic_label", "agent_category_label")
    domain = labels.canonical_label(F.col("abm_topic_label"), ["Ecology", "Economics", "Health", "Energy", "Transport"], [("habitat", "Ecology"), ("market", "Economics"), ("epidem", "Health"), ("traffic", "Transport")], "Other")
    return rows.select("rec_id", domain.alias("domain"), F.array_join(labels.entity_parts(F.col("agent_category_label")), "|").alias("entities"))


@query()
def f_json_objects(spark, folder):
    """The JSON object inside an answer with text around it."""
    answer = F.concat(F.lit("Answer: ```json "), F.to_json(F.struct("topic", "agent", "llm_used")), F.lit(" ``` done"))
    return table(spark, folder, "label_log").select("row_index", "logged_at", "received_at", labels.first_json_object(answer)["object"].alias("answer"))


@query()
def f_rebuilt_abstracts(spark, folder):
    """Abstracts rebuilt from an index of words to places."""
    words = _literature(spark, folder).where("trim(abstract) <> ''").select("rec_id", F.posexplode(F.split(keys.collapsed(F.col("abstract")), " ")).alias("place", "word"))
    index = words.groupBy("rec_id", "word").agg(F.collect_list("place").alias("places"))
    placed = index.select("rec_id", "word", F.explode("places").alias("place")).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return placed.select("rec_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("abstract"))


# --- filters ----------------------------------------------------------------------------------------------------------

_FOREIGN = "length(regexp_replace(coalesce(title, ''), '[^\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{0590}-\\x{05FF}\\x{0E00}-\\x{0E7F}\\x{0900}-\\x{097F}\\x{0E80}-\\x{0EFF}]', '', 'g'))"
_LATIN = "length(regexp_replace(coalesce(title, ''), '[^A-Za-z]', '', 'g'))"
_IS_FOREIGN = f"({_FOREIGN} > 0 and {_FOREIGN} / greatest({_FOREIGN} + {_LATIN}, 1) >= 0.2)"
_TYPES = ", ".join(f"'{t}'" for t in filters.DROPPED_TYPES)
_IS_DROPPED = f"list_has_any(list_transform(list_filter(list_transform(regexp_split_to_array(coalesce(doc_type, ''), '[;,]'), x -> trim(x)), x -> x <> ''), x -> lower(x)), [{_TYPES}])"


@query(f"select rec_id, {_IS_FOREIGN} as is_foreign, {_IS_DROPPED} as is_dropped_type, trim(coalesce(abstract, '')) = '' as is_blank, coalesce(times_cited, 0) = 0 as is_uncited, contains(lower(coalesce(source, '')), 'wos') as in_scope from merged_literature")
def c_conditions(spark, folder):
    """The conditions of the cleaning stage, one by one."""
    return _literature(spark, folder).select(
        "rec_id", filters.foreign_script(F.col("title")).alias("is_foreign"), filters.dropped_type(F.col("doc_type")).alias("is_dropped_type"),
        filters.blank(F.col("abstract")).alias("is_blank"), (F.coalesce("times_cited", F.lit(0)) == 0).alias("is_uncited"), F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit("wos")).alias("in_scope"),
    )


_ANCHOR = "(?i)agent[- ]based|individual[- ]based|multi[- ]?agent|simulation"


@query(f"""with r as (select case when {_IS_FOREIGN} then 2 when {_IS_DROPPED} then 3 when trim(coalesce(abstract, '')) = '' and not regexp_matches(coalesce(title, ''), '{_ANCHOR}') then 4 end as r from merged_literature),
n as (select count(*) as total, count(*) filter (r = 2) as s2, count(*) filter (r = 3) as s3, count(*) filter (r = 4) as s4 from r)
select 1 as step_no, 'out of scope' as step, 0 as removed, total as remaining, 0.0::double as pct_removed from n
union all select 2, 'title in another script', s2, total - s2, round(s2 / total * 100, 2) from n
union all select 3, 'document type', s3, total - s2 - s3, round(s3 / (total - s2) * 100, 2) from n
union all select 4, 'no abstract', s4, total - s2 - s3 - s4, round(s4 / (total - s2 - s3) * 100, 2) from n""")
def c_ledger(spark, folder):
    """What each cleaning step removes and leaves."""
    return stages.clean(_literature(spark, folder))[2]


@query(f"""select rec_id, case when {_IS_FOREIGN} then 'title in another script' when {_IS_DROPPED} then 'document type' else 'no abstract' end as drop_reason from merged_literature
where {_IS_FOREIGN} or {_IS_DROPPED} or (trim(coalesce(abstract, '')) = '' and not regexp_matches(coalesce(title, ''), '{_ANCHOR}'))""")
def c_removed(spark, folder):
    """Records removed by the cleaning stage, with the reason."""
    return stages.clean(_literature(spark, folder))[1].select("rec_id", "drop_reason")


EVIDENCE = filters.EvidenceRules(
    anchor="agent[- ]based|individual[- ]based",
    pair=(r"\bagents?\b", "simulat|model"),
    ambiguous=(("learning", r"\blearning\b"), ("network", r"\bnetworks?\b")),
    excluded=(("ligand", r"\bligands?\b"), ("antibody", r"\bantibod(y|ies)\b")),
)


@query(r"""with t as (select rec_id, coalesce(title, '') || ' ' || coalesce(abstract, '') as x from merged_literature),
e as (select *, len(regexp_extract_all(x, '(?i)agent[- ]based|individual[- ]based')) >= 1 or (regexp_matches(x, '(?i)\bagents?\b') and regexp_matches(x, '(?i)simulat|model')) as ok from t),
r as (select rec_id, case when regexp_matches(x, '(?i)\bantibod(y|ies)\b') then 'excluded: antibody' when regexp_matches(x, '(?i)\bligands?\b') then 'excluded: ligand'
  when regexp_matches(x, '(?i)\blearning\b') and not ok then 'ambiguous: learning' when regexp_matches(x, '(?i)\bnetworks?\b') and not ok then 'ambiguous: network' when not ok then 'no evidence' end as drop_reason from e)
select rec_id, drop_reason from r where drop_reason is not null""")
def c_evidence_gate(spark, folder):
    """Records that an evidence gate drops, with the reason."""
    rows = _literature(spark, folder).select("rec_id", filters.drop_reason(keys.title_and_abstract(F.col("title"), F.col("abstract")), EVIDENCE).alias("drop_reason"))
    return rows.where("drop_reason is not null")


@query("select rec_id, year_num from master where year_num between 1990 and 2025 and trim(coalesce(title, '')) <> '' and trim(coalesce(abstract, '')) <> ''")
def c_year_window(spark, folder):
    """Records of the years looked at that have a title and an abstract."""
    rows = table(spark, folder, "master")
    return rows.where(F.col("year_num").between(1990, 2025) & ~filters.blank(F.col("title")) & ~filters.blank(F.col("abstract"))).select("rec_id", "year_num")


@query(r"""select rec_id, case when regexp_matches(lower(title), 'erratum|editorial') then null else list_sort(list_distinct(list_transform(regexp_extract_all(lower(title), 'agent[- ]based|individual[- ]based|multi[- ]agent|simulation'), x -> x))) end::varchar as found
from merged_literature where title is not null""")
def c_matched_words(spark, folder):
    """Which words of a title match, none where an excluding word stands."""
    t = F.lower("title")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit("agent[- ]based|individual[- ]based|multi[- ]agent|simulation"), F.lit(0))))
    text = F.when(~t.rlike("erratum|editorial"), F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")))
    return _literature(spark, folder).where("title is not null").select("rec_id", text.alias("found"))


# --- merging ----------------------------------------------------------------------------------------------------------


def _merge_sql(key: str) -> str:
    first = ", ".join(f"coalesce(arg_min({c}, rec_id) filter (trim({c}) <> ''), '') as {c}" for c in merge.FIRST)
    united = ", ".join(
        f"array_to_string(list_filter(list_flat_{c}, (x, i) -> list_position(list_flat_{c}, x) = i), ';') as {c}" for c in merge.UNITED
    )
    flat = ", ".join(f"list_filter(list_transform(string_split(coalesce(string_agg({c}, ';' order by rec_id), ''), ';'), x -> trim(x)), x -> x <> '') as list_flat_{c}" for c in merge.UNITED)
    plain = ", ".join(merge.FIRST)
    return f"with k as (select *, {key} as merge_key from merged_literature), g as (select merge_key, min(rec_id) as first_id, count(*) as n_merged, {first}, {flat}, max(times_cited) as times_cited from k where merge_key <> '' group by merge_key) select merge_key, first_id, n_merged, {plain}, {united}, times_cited from g"


@query(_merge_sql(_DOI.format("doi")))
def m_doi_merge(spark, folder):
    """Records merged by DOI: first non-blank fields, united lists, the largest count."""
    return merge.doi_merge(_literature(spark, folder))


@query(_merge_sql(_TITLE.format("title")))
def m_title_merge(spark, folder):
    """Records merged by title."""
    return merge.title_merge(_literature(spark, folder))


@query()
def m_same_title(spark, folder):
    """Each record's representative among those of its title, by shared surnames."""
    return merge.same_title_representatives(_literature(spark, folder), people.surnames(people.split_authors(F.col("authors"))))


@query()
def m_merged_sources(spark, folder):
    """The merging stage: by DOI, then by title."""
    return stages.merge_sources(_literature(spark, folder))


@query()
def m_first_by_any_key(spark, folder):
    """Records that share neither uid, DOI nor title with an earlier kept one."""
    rows = _literature(spark, folder).withColumns({"doi": keys.doi_key(F.col("doi")), "title": keys.lowered(F.col("title"))})
    return merge.first_by_any_key(rows, ["uid", "doi", "title"], "rec_id").select("rec_id")


@query("select rec_id, oa_id, oa_cited_by_count from (select *, row_number() over (partition by rec_id order by oa_id, oa_cited_by_count desc, oa_referenced_works) as r from openalex_citations) where r = 1")
def m_first_of_key(spark, folder):
    """One citation row for each record."""
    order = ["oa_id", F.col("oa_cited_by_count").desc_nulls_last(), F.col("oa_referenced_works").asc_nulls_last()]
    return merge.first_of(table(spark, folder, "openalex_citations"), ["rec_id"], order).select("rec_id", "oa_id", "oa_cited_by_count")


@query(f"""with l as (select k as doi_key, arg_min(abstract, rec_id) as abstract from (select rec_id, abstract, {_DOI.format('doi')} as k from master where trim(coalesce(abstract, '')) <> '') where k <> '' group by k),
m as (select rec_id, abstract, {_DOI.format('doi')} as k from merged_literature)
select m.rec_id, case when trim(coalesce(m.abstract, '')) = '' then coalesce(l.abstract, m.abstract) else m.abstract end as abstract from m left join l on m.k = l.doi_key""")
def j_fill_abstracts(spark, folder):
    """Blank abstracts filled from the curated records by DOI."""
    known = table(spark, folder, "master").where(~filters.blank(F.col("abstract"))).select("rec_id", "abstract", keys.doi_key(F.col("doi")).alias("doi_key"))
    lookup = known.where("doi_key <> ''").groupBy("doi_key").agg(F.min_by("abstract", "rec_id").alias("abstract"))
    rows = _literature(spark, folder).select("rec_id", "abstract", keys.doi_key(F.col("doi")).alias("doi_key"))
    return merge.fill_from(rows, lookup, "doi_key", ["abstract"]).select("rec_id", "abstract")


@query(f"""with m as (select rec_id, {_LETTERS.format('title')} as t, {_DOI.format('doi')} as d from merged_literature), k as (select {_LETTERS.format('title')} as t, {_DOI.format('doi')} as d from master)
select rec_id from m where not exists (select 1 from k where k.t = m.t and k.t <> '') and not exists (select 1 from k where k.d = m.d and k.d <> '')""")
def j_without_known(spark, folder):
    """Records whose title and DOI the curated ones don't have."""
    return merge.without_known(_literature(spark, folder), table(spark, folder, "master")).select("rec_id")


@query()
def j_fuzzy_titles(spark, folder):
    """For each record the most similar title among all curated records that share one of its rare title words."""
    side = lambda df, p: df.where("trim(title) <> ''").select(F.col("rec_id").alias(f"{p}_id"), keys.title_words_key(F.col("title")).alias(f"{p}_title"), (~filters.blank(F.col("abstract"))).alias("has_abstract"))
    return merge.best_fuzzy_match(side(_literature(spark, folder), "left").drop("has_abstract"), side(table(spark, folder, "master"), "right")).withColumn("ratio", F.round("ratio", 6))


@query("select count(*) as positions, count(*) filter (m.title is distinct from l.title or m.doi is distinct from l.doi) as mismatches from (select rec_id, title, doi from master) m full join (select rec_id, title, doi from merged_literature where rec_id in (select rec_id from master)) l using (rec_id)")
def j_aligned(spark, folder):
    """Whether two tables agree, position by position."""
    left = table(spark, folder, "master").select("rec_id", "title", "doi")
    right = _literature(spark, folder).select("rec_id", "title", "doi").join(left.select("rec_id"), "rec_id", "left_semi")
    return merge.aligned(left, right, "rec_id", ["title", "doi"])[1]


@query("select m.rec_id, c.oa_cited_by_count, m.times_cited from master m left join (select rec_id, max(oa_cited_by_count) as oa_cited_by_count from openalex_citations group by 1) c using (rec_id)")
def j_citations(spark, folder):
    """Counts of two sources side by side."""
    counts = table(spark, folder, "openalex_citations").groupBy("rec_id").agg(F.max("oa_cited_by_count").alias("oa_cited_by_count"))
    return table(spark, folder, "master").select("rec_id", "times_cited").join(counts, "rec_id", "left")


# --- aggregates and ranks ---------------------------------------------------------------------------------------------


@query("select doc_type_std, is_llm, count(*) as n, count(distinct venue_name) as venues, avg(n_authors) as mean_authors, max(times_cited) as most_cited, median(year_num) as median_year from master group by all")
def a_counts(spark, folder):
    """Counts, distinct counts, means and medians by type."""
    return table(spark, folder, "master").groupBy("doc_type_std", "is_llm").agg(
        F.count("*").alias("n"), F.count_distinct("venue_name").alias("venues"), F.avg("n_authors").alias("mean_authors"), F.max("times_cited").alias("most_cited"), F.median("year_num").alias("median_year")
    )


@query("select unnest(countries) as country, count(*) as n from master group by 1")
def a_exploded_counts(spark, folder):
    """Records by country of any author."""
    return table(spark, folder, "master").select(F.explode("countries").alias("country")).groupBy("country").agg(F.count("*").alias("n"))


@query("select avg(case when trim(coalesce(abstract, '')) <> '' then 1.0 else 0.0 end) as abstract, avg(case when trim(coalesce(authors, '')) <> '' then 1.0 else 0.0 end) as authors, avg(case when trim(coalesce(doi, '')) <> '' then 1.0 else 0.0 end) as doi from merged_literature")
def a_fill_rates(spark, folder):
    """The share of records with a value."""
    return _literature(spark, folder).agg(*(F.avg(F.when(~filters.blank(F.col(c)), 1.0).otherwise(0.0)).alias(c) for c in ("abstract", "authors", "doi")))


@query("""with b as (select m.times_cited::double as a, c.n::double as b from master m join (select rec_id, max(oa_cited_by_count) as n from openalex_citations group by 1) c using (rec_id) where m.times_cited > 0 and c.n is not null),
r as (select a, b, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from b)
select count(*) as n, round(corr(a, b), 9) as pearson, round(corr(ra, rb), 9) as spearman, median(a) as median_a, quantile_cont(b, 0.85) as p85_b from r""")
def a_correlations(spark, folder):
    """Two sources' counts compared: linear and rank correlation, median, percentile."""
    counts = table(spark, folder, "openalex_citations").groupBy("rec_id").agg(F.max("oa_cited_by_count").cast("double").alias("b"))
    both = table(spark, folder, "master").where("times_cited > 0").select("rec_id", F.col("times_cited").cast("double").alias("a")).join(counts.where("b is not null"), "rec_id")
    ranked = ranking.average_rank(ranking.average_rank(both, "a", "ra"), "b", "rb")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 9).alias("pearson"), F.round(F.corr("ra", "rb"), 9).alias("spearman"), F.median("a").alias("median_a"), F.percentile("b", F.lit(0.85)).alias("p85_b"))


@query("select count(*) filter (coalesce(m.times_cited, 0) <= 0 and c.n > 0) as gap, round(100.0 * count(c.n) / count(*), 6) as coverage from master m left join (select rec_id, max(oa_cited_by_count) as n from openalex_citations group by 1) c using (rec_id)")
def a_coverage(spark, folder):
    """How many counts only the other source knows, and how many records it covers."""
    counts = table(spark, folder, "openalex_citations").groupBy("rec_id").agg(F.max("oa_cited_by_count").alias("n"))
    both = table(spark, folder, "master").select("rec_id", "times_cited").join(counts, "rec_id", "left")
    gap = F.coalesce(F.sum(F.when((F.coalesce("times_cited", F.lit(0)) <= 0) & (F.col("n") > 0), 1)), F.lit(0))
    return both.agg(gap.alias("gap"), F.round(100.0 * F.count("n") / F.count("*"), 6).alias("coverage"))


@query("""with n as (select rec_id, is_llm, unnest(string_split(name_key, ';')) as name from master where name_key <> '')
select name, count(distinct rec_id) as papers, count(distinct case when is_llm then rec_id end) as llm_papers from n group by name""")
def a_scholars(spark, folder):
    """Papers of each written name."""
    rows = table(spark, folder, "master").where("name_key <> ''").select("rec_id", "is_llm", F.explode(F.split("name_key", ";")).alias("name"))
    return rows.groupBy("name").agg(F.count_distinct("rec_id").alias("papers"), F.count_distinct(F.when(F.col("is_llm"), F.col("rec_id"))).alias("llm_papers"))


@query("select coalesce(error_type, '') as error_type, count(*) as n, sum(coalesce(total_tokens, 0))::bigint as tokens, sum(coalesce(cache_hit_tokens, 0))::bigint as cached from label_log group by 1")
def a_usage(spark, folder):
    """Tokens and errors of the log."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("bigint"))
    return table(spark, folder, "label_log").groupBy(F.coalesce("error_type", F.lit("")).alias("error_type")).agg(F.count("*").alias("n"), total("total_tokens").alias("tokens"), total("cache_hit_tokens").alias("cached"))


@query("select name, papers, rank() over (order by papers desc) + (count(*) over (partition by papers) - 1) / 2 as avg_rank from (select unnest(string_split(name_key, ';')) as name, count(*) as papers from master where name_key <> '' group by 1)")
def r_average_ranks(spark, folder):
    """Names ranked by papers, ties shared."""
    return ranking.average_rank(a_scholars(spark, folder).select("name", "papers"), "papers")


@query("""with s as (select name, count(*) as papers from (select unnest(string_split(name_key, ';')) as name from master where name_key <> '') group by 1),
r as (select papers, row_number() over (order by papers desc, name) as k, sum(papers) over (order by papers desc, name rows unbounded preceding) as run, sum(papers) over () as total from s)
select count(*) as n, max(total)::bigint as total, min(k) filter (run >= total * 0.5) as k from r""")
def r_concentration(spark, folder):
    """How many names hold half of all papers."""
    out = ranking.concentration(a_scholars(spark, folder), "papers")
    return out.select("n", F.col("total").cast("bigint").alias("total"), F.col("k").cast("bigint").alias("k"))


@query("select * from (select venue_name, rec_id, times_cited, row_number() over (partition by venue_name order by times_cited desc nulls last, rec_id) as rank from master) where rank <= 3")
def r_top_in_group(spark, folder):
    """The three most cited records of each venue."""
    rows = table(spark, folder, "master").select("venue_name", "rec_id", "times_cited")
    return ranking.top_in_group(rows, ["venue_name"], [F.col("times_cited").desc_nulls_last(), "rec_id"], 3)


@query("""with f as (select name, min(year_num) as year from (select unnest(string_split(name_key, ';')) as name, year_num from master where name_key <> '') group by 1), n as (select year, count(*) as "new" from f where year is not null group by 1)
select year, "new", sum("new") over (order by year)::bigint as total from n""")
def r_growth(spark, folder):
    """New and all names by year."""
    rows = table(spark, folder, "master").where("name_key <> ''").select(F.explode(F.split("name_key", ";")).alias("name"), F.col("year_num").alias("year"))
    return ranking.cumulative_first_seen(rows, "name", "year")


@query("select rec_id, title, lang, null::bigint as doc_id from merged_literature union all by name select null as rec_id, null as title, lang, doc_id from documents")
def u_ragged_union(spark, folder):
    """Tables of different columns put together by name."""
    return _literature(spark, folder).select("rec_id", "title", "lang").unionByName(table(spark, folder, "documents").select("lang", "doc_id"), allowMissingColumns=True)


@query("with a as (select distinct rec_id from master), b as (select distinct rec_id from openalex_citations) select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from a join b using (rec_id)) as n_both, (select count(*) from a where rec_id not in (select rec_id from b)) as n_only_a")
def u_set_sizes(spark, folder):
    """Sizes of intersection and difference."""
    a, b = table(spark, folder, "master").select("rec_id").distinct(), table(spark, folder, "openalex_citations").select("rec_id").distinct()
    joined = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "rec_id", "full")
    return joined.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.coalesce(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)), F.lit(0)).alias("n_both"), F.coalesce(F.sum(F.when(F.col("b").isNull(), 1)), F.lit(0)).alias("n_only_a"))


# --- graphs -----------------------------------------------------------------------------------------------------------


def _author_edges(spark: SparkSession, folder: str, weighted: bool = True) -> DataFrame:
    names = table(spark, folder, "master").select(people.network_names(F.col("authors_list")).alias("names"))
    return graph.pair_edges(names, "names", weighted)


_NAMES = "select rec_id, list_filter(n, (x, i) -> list_position(n, x) = i) as names from (select rec_id, list_filter(list_transform(authors_list, a -> lower(trim(regexp_replace(coalesce(a.last_name, '') || ' ' || coalesce(a.first_name, ''), '[\\s\\p{Z}]+', ' ', 'g')))), x -> x <> '') as n from master)"
_EDGES = f"""names as ({_NAMES}), places as (select rec_id, len(names) as n, unnest(names) as name, generate_subscripts(names, 1) as i from names),
w as (select *, case when n <= 1 or i = 1 then 1.0 when i = n then 0.75 when i = 2 then 0.6 else 0.35 end::double as w from places),
edges as (select least(a.name, b.name) as source, greatest(a.name, b.name) as target, sum(a.w * b.w) as weight, count(*) as papers from w a join w b on a.rec_id = b.rec_id and a.i < b.i group by 1, 2)"""


@query(f"with {_EDGES} select source, target, round(weight, 6) as weight, papers from edges")
def g_edges(spark, folder):
    """Co-authorship edges weighted by place."""
    return _author_edges(spark, folder).select("source", "target", F.round("weight", 6).alias("weight"), "papers")


@query(f"with {_EDGES}, d as (select source as node, weight from edges union all select target, weight from edges) select node, count(*) as degree, round(sum(weight), 6) as weighted_degree from d group by node")
def g_degrees(spark, folder):
    return graph.degrees(_author_edges(spark, folder)).select("node", "degree", F.round("weighted_degree", 6).alias("weighted_degree"))


@query(f"with {_EDGES}, d as (select source as node from edges union all select target from edges), k as (select node, count(*) as degree from d group by 1) select degree, count(*) as nodes from k group by 1")
def g_degree_distribution(spark, folder):
    return graph.degrees(_author_edges(spark, folder)).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(f"with {_EDGES}, n as (select count(distinct x) as nodes from (select source as x from edges union all select target from edges)), m as (select count(*) as edges from edges) select nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 12) as density from n, m")
def g_density(spark, folder):
    return graph.density(_author_edges(spark, folder)).withColumn("density", F.round("density", 12))


@query()
def g_components(spark, folder):
    """Connected components of the co-authorship graph."""
    return graph.components(_author_edges(spark, folder))


@query(f"""with {_EDGES}, u as (select source as a, target as b from edges union all select target, source from edges), d as (select a as node, count(*) as degree from u group by 1),
t as (select x.a as node, count(*) / 2 as triangles from u x join u y on x.a = y.a join u z on z.a = x.b and z.b = y.b where x.b <> y.b group by 1)
select node, coalesce(triangles, 0)::bigint as triangles, round(case when degree >= 2 then 2 * coalesce(triangles, 0) / (degree * (degree - 1)) else 0 end, 9) as coefficient from d left join t using (node)""")
def g_clustering(spark, folder):
    return graph.clustering(_author_edges(spark, folder)).withColumn("coefficient", F.round("coefficient", 9))


@query(f"with {_EDGES}, d as (select x, count(*) as n from (select source as x from edges union all select target from edges) group by 1 having count(*) >= 10) select source, target, papers from edges where source in (select x from d) and target in (select x from d)")
def g_pruned(spark, folder):
    return graph.pruned(_author_edges(spark, folder), 10).select("source", "target", "papers")


@query(f"with {_EDGES} select source, target, papers from edges where round(weight, 6) >= (select quantile_cont(round(weight, 6), 0.85) from edges)")
def g_heavy_edges(spark, folder):
    rounded = _author_edges(spark, folder).withColumn("weight", F.round("weight", 6))
    return graph.heavy_edges(rounded, 0.85).select("source", "target", "papers")


_C_EDGES = "c as (select rec_id, list_sort(list_distinct(countries)) as k from master), p as (select rec_id, unnest(k) as x from c), edges as (select a.x as source, b.x as target, count(*)::double as weight from p a join p b on a.rec_id = b.rec_id and a.x < b.x group by 1, 2)"


def _country_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.pair_edges(table(spark, folder, "master").select(F.array_distinct("countries").alias("k")), "k", weighted=False)


@query(f"with {_C_EDGES} select source, target, weight from edges")
def g_country_edges(spark, folder):
    """Countries that work together."""
    return _country_edges(spark, folder).select("source", "target", "weight")


@query(f"""with {_C_EDGES}, d as (select x, sum(w) as w from (select source as x, weight as w from edges union all select target, weight from edges) group by 1), t as (select x from d order by w desc, x limit 18), b as (select source as a, target as b, weight from edges union all select target, source, weight from edges)
select a.x as country, b.x as other, coalesce(sum(e.weight), 0) as weight from t a cross join t b left join b e on e.a = a.x and e.b = b.x group by 1, 2""")
def g_country_matrix(spark, folder):
    """The symmetric matrix of the 18 countries of the largest weight, one row for each cell."""
    edges = _country_edges(spark, folder).select("source", "target", "weight")
    top = graph.degrees(edges).orderBy(F.desc("weighted_degree"), "node").limit(18).select("node")
    both = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    cells = top.select(F.col("node").alias("source")).join(F.broadcast(top.select(F.col("node").alias("target"))))  # 18 rows
    return cells.join(both, ["source", "target"], "left").select(F.col("source").alias("country"), F.col("target").alias("other"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query("select cast(year_num as int) as year, count(*) as papers, round(100.0 * avg(case when len(countries) > 1 then 1 else 0 end), 6) as international from master where year_num is not null and len(countries) > 0 group by 1 having count(*) >= 30")
def g_international(spark, folder):
    """The share of papers from several countries, for years with thirty papers or more."""
    rows = table(spark, folder, "master").where("year_num is not null and size(countries) > 0")
    out = rows.groupBy(F.col("year_num").cast("int").alias("year")).agg(F.count("*").alias("papers"), F.round(100.0 * F.avg(F.when(F.size("countries") > 1, 1).otherwise(0)), 6).alias("international"))
    return out.where("papers >= 30")


def _partition(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    edges = _country_edges(spark, folder).select("source", "target", "weight")
    return edges, graph.communities(edges)


@query()
def g_communities(spark, folder):
    """Communities of co-authors by label propagation."""
    return graph.communities(graph.pruned(_author_edges(spark, folder), 3))


@query()
def g_modularity(spark, folder):
    """Modularity of the countries' communities, with and without weights."""
    edges, found = _partition(spark, folder)
    return graph.modularity(edges, found).withColumn("kind", F.lit("weighted")).unionByName(graph.modularity(edges, found, False).withColumn("kind", F.lit("plain")))


@query()
def g_agreement(spark, folder):
    """How far the components and the communities of co-authors put the same nodes together."""
    edges = graph.pruned(_author_edges(spark, folder), 3)
    return graph.partition_agreement(graph.components(edges).withColumnRenamed("component", "community"), graph.communities(edges))


@query()
def g_centrality(spark, folder):
    """Eigenvector centrality and betweenness of the countries."""
    edges = _country_edges(spark, folder).select("source", "target", "weight")
    both = graph.eigenvector_centrality(edges).join(graph.betweenness(edges), "node")
    return both.select("node", F.round("centrality", 6).alias("centrality"), F.round("betweenness", 6).alias("betweenness"))


@query()
def g_growth(spark, folder):
    """Authors, edges, mean degrees and the largest component's share, year by year, all papers up to the year taken together."""
    rows = table(spark, folder, "master").where("year_num is not null").select(F.col("year_num").cast("int").alias("year"), people.network_names(F.col("authors_list")).alias("names"))
    return graph.growth(rows, "year", "names")


# --- lift -------------------------------------------------------------------------------------------------------------

_KEYS = "k as (select rec_id, abm_topic as topic, unnest(keywords_list) as keyword from master where abm_topic is not null)"
_LIFT = f"""{_KEYS}, d as (select distinct * from k where keyword is not null), n as (select topic, keyword, count(*) as n_docs from d group by 1, 2), g as (select topic, count(distinct rec_id) as group_docs from k group by 1),
o as (select keyword, count(distinct rec_id) as all_n from d group by 1), e as (select count(distinct rec_id) as all_docs from k),
lifts as (select topic, keyword, n_docs, group_docs, round((n_docs / group_docs) / (all_n / all_docs), 9) as lift from n join g using (topic) join o using (keyword), e)"""


def _keyword_lifts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "master").where("abm_topic is not null").select("rec_id", F.col("abm_topic").alias("topic"), F.explode("keywords_list").alias("keyword"))
    return lift.lifts(rows, "topic", "keyword", "rec_id").withColumn("lift", F.round("lift", 9))


@query(f"with {_LIFT} select topic, keyword, n_docs, group_docs, lift from lifts")
def l_keyword_lift(spark, folder):
    """How much more frequent a keyword is in a topic than over all."""
    return _keyword_lifts(spark, folder)


@query(f"""with {_LIFT}, m as (select *, n_docs >= 5 and lift >= 1.2 as marked from lifts), a as (select *, bool_or(marked) over (partition by topic) as any_marked from m),
r as (select *, row_number() over (partition by topic order by lift desc, n_docs desc, keyword) as rank from a where marked or not any_marked)
select topic, keyword, n_docs, lift, rank from r where rank <= case when any_marked then 4 else 3 end""")
def l_signatures(spark, folder):
    """The keywords that mark each topic."""
    return lift.signatures(_keyword_lifts(spark, folder), "topic", "keyword", 5, 1.2, 4, 3)


@query("""with r as (select abm_topic as topic, agent_category as agent from master where abm_topic is not null and agent_category is not null), n as (select topic, agent, count(*) as n from r group by 1, 2), t as (select agent, sum(n) as all_n from n group by 1), e as (select count(*) as every from r),
x as (select *, sum(n) over (partition by topic) as size, row_number() over (partition by topic order by n desc, agent) as q from n)
select topic, agent, round(100 * n / size, 9) as share, round((n / size) / (all_n / every), 9) as lift from x join t using (agent), e where q = 1""")
def l_contrast(spark, folder):
    """Each topic's most frequent kind of agent, and how it stands out."""
    rows = table(spark, folder, "master").where("abm_topic is not null").select(F.col("abm_topic").alias("topic"), F.col("agent_category").alias("agent"))
    return lift.contrast(rows, "topic", "agent").select("topic", "agent", F.round("share", 9).alias("share"), F.round("lift", 9).alias("lift"))


@query("select topic, country, n, round(100 * n / sum(n) over (partition by topic), 9) as share from (select abm_topic as topic, unnest(countries) as country, count(*) as n from master where abm_topic is not null group by 1, 2)")
def l_shares(spark, folder):
    """Shares of countries in each topic."""
    rows = table(spark, folder, "master").where("abm_topic is not null").select(F.col("abm_topic").alias("topic"), F.explode("countries").alias("country"))
    return lift.value_shares(rows, "topic", "country").withColumn("share", F.round("share", 9))


@query("select abm_topic as topic, count(*) as papers, round(avg(n_authors), 2) as mean_authors, median(year_num) as median_year, round(100 * avg(case when len(countries) > 1 then 1.0 else 0.0 end), 6) as international from master where abm_topic is not null group by 1 having count(*) >= 20")
def l_profiles(spark, folder):
    """Topics with twenty papers or more: size, team, year, share of international papers."""
    rows = table(spark, folder, "master").where("abm_topic is not null").groupBy(F.col("abm_topic").alias("topic"))
    out = rows.agg(F.count("*").alias("papers"), F.round(F.avg("n_authors"), 2).alias("mean_authors"), F.median("year_num").alias("median_year"), F.round(100 * F.avg(F.when(F.size("countries") > 1, 1.0).otherwise(0.0)), 6).alias("international"))
    return out.where("papers >= 20")


# --- the labelling log ------------------------------------------------------------------------------------------------


@query("""select row_index, topic, total_tokens, logged_at from (select *, row_number() over (partition by row_index order by logged_at desc, received_at desc, coalesce(total_tokens, 0) desc, coalesce(topic, '') desc) as r from label_log where status = 'success' and row_index is not null) where r = 1""")
def t_last_success(spark, folder):
    """The last success of each row."""
    return log.last_success(table(spark, folder, "label_log")).select("row_index", "topic", "total_tokens", "logged_at")


@query("select rec_id from master where rec_id not in (select row_index from label_log where status = 'success' and row_index is not null)")
def t_pending(spark, folder):
    """Rows without a success."""
    done = log.last_success(table(spark, folder, "label_log"))
    return log.pending(table(spark, folder, "master").select("rec_id"), done, "rec_id", "row_index")


@query("""with s as (select row_index, doi from (select *, row_number() over (partition by row_index order by logged_at desc, received_at desc, coalesce(total_tokens, 0) desc, coalesce(topic, '') desc) as r from label_log where status = 'success' and row_index is not null) where r = 1)
select count(*) as n_matched, count(*) filter (coalesce(s.doi, '') <> coalesce(m.doi, '')) as n_stale, count(*) filter (coalesce(s.doi, '') <> coalesce(m.doi, '')) / greatest(count(*), 1) as stale_share from s join master m on m.rec_id = s.row_index""")
def t_stale(spark, folder):
    """How many successes carry another fingerprint than their row."""
    done = log.last_success(table(spark, folder, "label_log"))
    return log.stale_share(table(spark, folder, "master"), done, "rec_id", "row_index", "doi")


@query("select date_trunc('hour', logged_at) as window_start, count(*) as n_lines, count(*) filter (status = 'failed') as n_failed, sum(coalesce(total_tokens, 0))::bigint as tokens from label_log where logged_at is not null group by 1")
def t_rates(spark, folder):
    """Lines, failures and tokens by hour."""
    return log.log_rates(table(spark, folder, "label_log"))
