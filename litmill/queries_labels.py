"""More queries of the core: labels, enrichment, rescue lists, communities of authors. They register beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmill.functions import keys, labels, people, taxonomy
from litmill.operators import filters, graph, lift, merge, ranking
from litmill.queries import _CODE, _DOI, _EDGES, _TITLE, QUERIES, SQL, _author_edges, _country_edges, _literature, query, table
from litmill.streaming import log

_NAMES = "list_filter(list_transform(string_split(coalesce(authors, ''), ';'), x -> trim(x)), x -> x <> '')"
SQL["f_split_names"] = f"""with n as (select rec_id, {_NAMES.replace('x -> ', 'lambda x: ')} as k from merged_literature), u as (select rec_id, unnest(k) as name, unnest(generate_series(1, len(k))) as position from n),
w as (select rec_id, position, trim(regexp_replace(name, '\\s+', ' ', 'g')) as t from u),
p as (select *, strpos(t, ',') > 0 and trim(split_part(t, ',', 1)) <> '' and trim(substr(t, strpos(t, ',') + 1)) <> '' as parted from w)
select rec_id, position, case when parted then trim(substr(t, strpos(t, ',') + 1)) when contains(t, ' ') then trim(regexp_replace(t, ' [^ ]+$', '')) else '' end as first_name,
  case when parted then trim(split_part(t, ',', 1)) else split_part(t, ' ', -1) end as last_name from p"""
SQL["f_rebuilt_abstracts"] = r"select rec_id, trim(regexp_replace(replace(abstract, chr(0), ' '), '\s+', ' ', 'g')) as abstract from merged_literature where trim(abstract) <> ''"

_STOP = ", ".join(f"'{x}'" for x in labels.EMPTY_ENTITIES)
SQL["f_entities"] = rf"""with m as (select rec_id, lower(abm_topic_label) as t, trim(abm_topic_label) as label, coalesce(agent_category_label, '') as g from master where abm_topic_label is not null),
e as (select rec_id, list_filter(list_transform(regexp_split_to_array(replace(g, 'not_applicable', ' '), '[,/;]|\band\b|&'), lambda x: lower(trim(regexp_replace(trim(x, ' .;-'), '\s+', ' ', 'g')))), lambda x: length(x) > 2 and x not in ({_STOP})) as k from m)
select m.rec_id, case when t like '%ecology%' then 'Ecology' when t like '%economics%' then 'Economics' when t like '%health%' then 'Health' when t like '%energy%' then 'Energy' when t like '%transport%' then 'Transport'
  when t like '%habitat%' then 'Ecology' when t like '%market%' then 'Economics' when t like '%epidem%' then 'Health' when t like '%traffic%' then 'Transport' else 'Other' end as domain,
  array_to_string(list_sort(list_distinct(k)), '|') as entities from m join e using (rec_id)"""


def _case(column: str, text: str, default: str) -> str:
    rows = " ".join(f"when '{k}' then '{v}'" for k, v in taxonomy.entries(text).items())
    return f"coalesce(case {column} {rows} end, '{default}')"


_ANSWER = """'{"topic": "' || coalesce(topic, '') || '", "agent": "' || coalesce(agent, '') || '", "agent_type": "' || coalesce(agent_type, '') || '", "llm_used": ' || coalesce(cast(llm_used as varchar), 'null') || ', "llm_role": "' || coalesce(llm_role, '') || '"}'"""


@query(f"""with a as (select *, {_ANSWER} as answer, {_CODE.format('topic', 'T', 32)} as t, {_CODE.format('agent', 'A', 15)} as g, {_CODE.format('agent_type', 'A', 15)} as h, {_CODE.format('llm_role', 'L', 20)} as r from label_log),
e as (select *, case when llm_used is null or llm_used not in (0, 1) then 'invalid llm_used' when t is null then 'unrecognised T code' when g is null or h is null then 'unrecognised A code' when g <> h then 'agent_type must match agent' when r is null then 'unrecognised L code' end as why from a)
select row_index, logged_at, received_at, answer as object, 'unbalanced JSON (truncated)' as cut_error, case when why is null then t end as topic_code, case when why is null then g end as agent_code,
  case when why is null then llm_used end as used, case when why is null then case when llm_used = 0 then 'L01' else r end end as role_code, why as error from e""")
def f_classified(spark, folder):
    """Answers with text around them read and checked; one that breaks off is none, whatever objects it holds inside."""
    rows = table(spark, folder, "label_log").withColumn("answer", F.expr(_ANSWER.replace("varchar", "string")))
    whole, cut = F.concat(F.lit("Here it is:\n```json\n"), "answer", F.lit("\n``` done {x}")), F.concat(F.lit('{"inner": '), "answer", F.lit(', "rest":'))
    read = rows.withColumns({"found": labels.first_json_object(whole), "cut": labels.first_json_object(cut)}).withColumn("c", labels.classification(F.col("found.object")))
    return read.select(
        "row_index", "logged_at", "received_at", F.col("found.object").alias("object"), F.col("cut.error").alias("cut_error"), F.col("c.topic").alias("topic_code"),
        F.col("c.agent").alias("agent_code"), F.col("c.llm_used").alias("used"), F.col("c.llm_role").alias("role_code"), F.col("c.error").alias("error"),
    )


@query(f"""select rec_id, {_case('abm_topic', taxonomy.TOPIC_CATEGORY, 'Other / General Domain')} as legacy_topic_category, {_case('agent_category', taxonomy.AGENT_TYPES, 'Unspecified')} as legacy_agent_types,
  {_case('llm_role', taxonomy.ROLES, 'None')} as legacy_llm_role, case when abm_topic is null then 'unlabelled' else 'crosswalk_from_T/A/L' end as legacy_label_source, {_case('abm_topic', taxonomy.TOPICS, '')} as topic_label from master""")
def f_crosswalk(spark, folder):
    """Labels of the older scheme for each record."""
    done = taxonomy.crosswalk(table(spark, folder, "master"))
    names = taxonomy.dimension(spark, taxonomy.TOPICS).withColumnsRenamed({"code": "abm_topic", "label": "topic_label"})
    return done.join(F.broadcast(names), "abm_topic", "left").select("rec_id", "legacy_topic_category", "legacy_agent_types", "legacy_llm_role", "legacy_label_source", F.coalesce("topic_label", F.lit("")).alias("topic_label"))  # 32 rows


@query("select topic as code, count(*) as n from label_log where topic is not null and topic not in (" + ", ".join(f"'{c}'" for c in taxonomy.entries(taxonomy.TOPIC_CATEGORY)) + ") group by 1")
def f_unmapped_codes(spark, folder):
    """Codes of the log that the crosswalk doesn't have, as they are written."""
    return taxonomy.unmapped(table(spark, folder, "label_log"), "topic", taxonomy.entries(taxonomy.TOPIC_CATEGORY))


_KIND = " ".join(f"when regexp_matches(p, '{w}', 'i') then '{k}'" for k, w in labels.AGENT_KINDS)


@query(f"""with t as (select rec_id, unnest(regexp_split_to_array(replace(agent_category_label, 'not_applicable', ''), '[,/;]| and ')) as x from master where agent_category_label is not null),
p as (select rec_id, trim(regexp_replace(trim(x, ' .;'), '\\s+', ' ', 'g')) as p from t), k as (select rec_id, case when length(p) < 3 then null {_KIND} end as kind from p)
select rec_id, kind, count(*) as n from k where kind is not null group by all""")
def f_agent_kinds(spark, folder):
    """Kinds of the agents that a record's label names, with their number."""
    rows = table(spark, folder, "master").select("rec_id", F.explode(labels.agent_kinds(F.col("agent_category_label"))).alias("kind"))
    return rows.groupBy("rec_id", "kind").agg(F.count("*").alias("n"))


_NAME = " ".join("when '{}' then '{}'".format(*x.split(" ", 1)) for x in people.COUNTRIES.split(";"))
_REGION = " ".join(f"when c in ({', '.join(repr(x) for x in codes.split())}) then '{name}'" for name, codes in people.REGIONS)


@query(f"with u as (select unnest(countries) as c from master) select c as country, coalesce(case upper(trim(c)) {_NAME} end, upper(trim(c))) as country_name, case {_REGION} else 'Other' end as region, count(*) as n from u group by all")
def f_countries(spark, folder):
    """Countries by name and region."""
    rows = table(spark, folder, "master").select(F.explode("countries").alias("country"))
    return rows.groupBy("country", people.country_name(F.col("country")).alias("country_name"), people.region(F.col("country")).alias("region")).agg(F.count("*").alias("n"))


@query(r"""with w as (select rec_id, lower(trim(coalesce(a.last_name, '') || ' ' || coalesce(a.first_name, ''))) as n from (select rec_id, unnest(authors_list) as a from master)),
k as (select rec_id, n, string_split(trim(regexp_replace(replace(n, '.', ' '), '\s+', ' ', 'g')), ' ') as p, string_split(trim(regexp_replace(n, '\s+', ' ', 'g')), ' ') as q from w where n <> '' and regexp_full_match(n, '[a-z .]+'))
select rec_id, n as name, upper(p[1][1:1]) || lower(p[1][2:]) || case when len(p) > 1 then ' ' || upper(p[2][1:1]) || '.' else '' end as label,
  case when len(q) > 1 then upper(q[1][1:1]) || '. ' else '' end || upper(q[1][1:1]) || q[1][2:] as short from k""")
def f_author_labels(spark, folder):
    """Labels of the names of Latin letters, surname first; the other names have no independent form to compare with."""
    named = table(spark, folder, "master").select("rec_id", F.explode("authors_list").alias("a")).select("rec_id", F.lower(F.trim(F.concat(F.coalesce("a.last_name", F.lit("")), F.lit(" "), F.coalesce("a.first_name", F.lit(""))))).alias("name"))
    return named.where(F.col("name").rlike("^[a-z .]+$")).select("rec_id", "name", people.author_label(F.col("name")).alias("label"), people.abbreviated(F.col("name")).alias("short"))


@query("""with a as (select rec_id, unnest(authors_list) as a, unnest(generate_series(1, len(authors_list))) as position from master)
select rec_id, position, trim(regexp_replace(trim(coalesce(a.first_name, '')), '\\s+', ' ', 'g')) as first_name, trim(regexp_replace(trim(coalesce(a.last_name, '')), '\\s+', ' ', 'g')) as last_name, coalesce(a.role, '') as role, trim(coalesce(a.orcid, '')) as orcid,
  len(list_filter(a.institutions, lambda i: trim(coalesce(i.institution, '')) <> '')) as places from a where trim(coalesce(a.first_name, '')) <> '' and trim(coalesce(a.last_name, '')) <> ''""")
def f_authorships(spark, folder):
    """Author structs made of harvested authorships, here written from the curated ones that have both names."""
    at = lambda a: F.transform(a["institutions"], lambda i: F.struct(i["institution"].alias("display_name"), i["country"].alias("country_code"), i["type"].alias("type"), i["ror"].alias("ror")))
    full = lambda a: (F.trim(F.coalesce(a["first_name"], F.lit(""))) != "") & (F.trim(F.coalesce(a["last_name"], F.lit(""))) != "")
    raw = lambda a: F.struct(
        F.struct(F.when(full(a), F.concat_ws(" ", a["first_name"], a["last_name"])).alias("display_name"), a["orcid"].alias("orcid")).alias("author"),
        F.when(full(a), F.concat_ws(", ", a["last_name"], a["first_name"])).alias("raw_author_name"), a["role"].alias("author_position"), a["is_corresponding"].alias("is_corresponding"), at(a).alias("institutions"),
    )
    made = table(spark, folder, "master").select("rec_id", people.authorships(F.transform("authors_list", raw)).alias("x"))
    one = made.select("rec_id", F.explode("x.authors").alias("a"))
    return one.select("rec_id", F.col("a.position").cast("bigint").alias("position"), "a.first_name", "a.last_name", "a.role", "a.orcid", F.size("a.institutions").cast("bigint").alias("places"))


@query("select rec_id, 'Classify the following scientific paper.' || chr(10) || chr(10) || 'TITLE:' || chr(10) || coalesce(title, '') || chr(10) || chr(10) || 'ABSTRACT:' || chr(10) || coalesce(abstract, '') || chr(10) || chr(10) || 'Return JSON only.' as prompt from master")
def f_prompts(spark, folder):
    """The text that asks for a label."""
    return table(spark, folder, "master").select("rec_id", keys.prompt(F.col("title"), F.col("abstract")).alias("prompt"))


_KEY = r"lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')))"


@query(f"""with t as (select rec_id, {_KEY.format('journal')} as j, {_KEY.format('venue')} as v, trim(coalesce(abstract, '')) = '' as bare from merged_literature)
select rec_id, case when bare then 'no abstract' else 'journal on drop list' end as drop_reason from t where (bare or 'ecological modelling' in (j, v)) and not ('journal of artificial societies and social simulation' in (j, v))""")
def c_journal_lists(spark, folder):
    """Drop reasons after venues that are always dropped or kept."""
    reason = F.when(filters.blank(F.col("abstract")), "no abstract")
    listed = filters.journal_override(reason, F.col("journal"), F.col("venue"), ["Journal of Artificial Societies and Social Simulation"], ["Ecological  Modelling"])
    return _literature(spark, folder).select("rec_id", listed.alias("drop_reason")).where("drop_reason is not null")


_TEXT = "coalesce(title, '') || ' ' || coalesce(abstract, '')"


@query(f"select rec_id, case when regexp_matches({_TEXT}, '{filters.DRIFTED}') then 'multi-agent' when regexp_matches({_TEXT}, '{filters.SWARMS}') then 'swarm/robot' else 'label' end as drift from master where regexp_matches({_TEXT}, '{filters.DRIFTED}') or regexp_matches({_TEXT}, '{filters.SWARMS}') or abm_topic = 'T30'")
def c_drift(spark, folder):
    """Curated records that drifted to a neighbouring field."""
    return table(spark, folder, "master").select("rec_id", filters.drift(keys.title_and_abstract(F.col("title"), F.col("abstract")), F.col("abm_topic")).alias("drift")).where("drift is not null")


@query(f"select rec_id, coalesce(abm_topic is not null and regexp_matches(title, '{filters.CLASSIC}'), false) as in_scope, case when abm_topic is not null and not coalesce(regexp_matches(title, '{filters.CLASSIC}'), false) then -1 else llm_used_num end as used from master")
def c_classic_scope(spark, folder):
    """Labelled records of a classic method (named in the title), and the flag of the others."""
    scope, used = filters.classic_scope(F.col("abm_topic").isNotNull(), F.col("title"), F.col("llm_used_num"))
    return table(spark, folder, "master").select("rec_id", scope.alias("in_scope"), used.alias("used"))


@query(f"""with f as (select k, arg_min(abstract, rec_id) as abstract, arg_min(last, rec_id) as last from (select rec_id, {_TITLE.format('title')} as k, abstract, list_filter(list_transform(authors_list, lambda a: lower(trim(coalesce(a.last_name, '')))), lambda x: x <> '') as last from master where trim(coalesce(abstract, '')) <> '') where k <> '' group by k),
m as (select rec_id, abstract, {_TITLE.format('title')} as k, list_transform({_NAMES.replace('x -> ', 'lambda x: ')}, lambda x: lower(case when contains(x, ',') then trim(split_part(x, ',', 1)) else split_part(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' ', -1) end)) as own from merged_literature)
select m.rec_id, case when trim(coalesce(m.abstract, '')) = '' and not coalesce(len(m.own) > 0 and len(f.last) > 0 and not list_has_any(m.own, f.last), false) then coalesce(f.abstract, m.abstract) else m.abstract end as abstract from m left join f on m.k = f.k""")
def j_title_enriched(spark, folder):
    """Blank abstracts filled by title, but for works of that title by other people."""
    last = F.transform("authors_list", lambda a: F.coalesce(a["last_name"], F.lit("")))
    known = table(spark, folder, "master").where(~filters.blank(F.col("abstract"))).select("rec_id", keys.title_words_key(F.col("title")).alias("title_key"), "abstract", last.alias("last_names"))
    found = known.where("title_key <> ''").groupBy("title_key").agg(F.min_by("abstract", "rec_id").alias("abstract"), F.min_by("last_names", "rec_id").alias("last_names"))
    return merge.fill_by_title(_literature(spark, folder), found, ["abstract"]).select("rec_id", "abstract")


@query(r"""with k as (select rec_id, lower(regexp_replace(coalesce(doi, ''), '^\s+|\s+$', '', 'g')) as d from merged_literature), h as (select d, min(rec_id) as h from k group by 1)
select rec_id, d = '' as blank from k join h using (d) where rec_id = h""")
def m_one_for_each_doi(spark, folder):
    """The first record of each DOI, of those without one only the first of all."""
    return merge.one_for_each_doi(_literature(spark, folder), blank_is_key=True).select("rec_id", (keys.lowered(F.col("doi")) == "").alias("blank"))


@query(f"""with {_EDGES}, d as (select x, count(*) as degree, round(sum(w), 6) as weight from (select source as x, weight as w from edges union all select target, weight from edges) group by 1),
r as (select rank() over (order by degree desc) + (count(*) over (partition by degree) - 1) / 2 as a, rank() over (order by weight desc) + (count(*) over (partition by weight) - 1) / 2 as b from d) select count(*) as n, count(*) filter (abs(a - b) > 1000) as shifted from r""")
def r_rank_shift(spark, folder):
    """Authors whose place by degree and by weighted degree lies more than a thousand apart."""
    degree = graph.degrees(_author_edges(spark, folder)).select("node", "degree", F.round("weighted_degree", 6).alias("weighted_degree"))
    return ranking.rank_shift(degree, "degree", "weighted_degree", 1000)


@query("select rec_id, source, year from (select rec_id, source, year, row_number() over (order by source nulls first, year nulls first, rec_id) as r from merged_literature) where r <= 100")
def r_first_sorted(spark, folder):
    """The first hundred records by source and year."""
    return ranking.first_rows(_literature(spark, folder).select("rec_id", "source", "year"), ["source", "year", "rec_id"], 100)


@query("""with p as (select rec_id, list_sort(list_distinct(countries)) as k from master), w as (select rec_id, k, case when len(k) <= 3 then 1.25 when len(k) <= 6 then 1.15 else 1.0 end::double as w from p), u as (select rec_id, unnest(k) as x, w from w)
select a.x as source, b.x as target, round(sum(a.w), 6) as weight from u a join u b on a.rec_id = b.rec_id and a.x < b.x group by 1, 2""")
def g_country_weights(spark, folder):
    """Countries that work together, papers of few countries weighing more."""
    rows = table(spark, folder, "master").select(F.array_distinct("countries").alias("k")).withColumn("pw", graph.paper_weight(F.size("k")))
    return graph.paired(rows, "k", False, "pw").groupBy("source", "target").agg(F.round(F.sum("pw"), 6).alias("weight"))


@query("""with w as (select year, count(*) as total from merged_literature where year is not null group by 1), f as (select year, count(*) as fetched from master group by 1)
select year, coalesce(fetched, 0) + 1 as next_row from w left join f using (year) where fetched is null or fetched < total""")
def t_incomplete_years(spark, folder):
    """Years of which the curated table holds fewer records than were harvested, and where to go on."""
    rows = _literature(spark, folder).where("year is not null")
    total = rows.groupBy("year").agg(F.count("*").alias("total"))
    fetched = table(spark, folder, "master").groupBy("year").agg(F.count("*").alias("fetched"))
    return log.incomplete(fetched.join(total, "year"), rows, "year")


def _communities(spark, folder):
    """Communities of the pruned author graph; documents with their community; members."""
    edges = graph.pruned(_author_edges(spark, folder), 3)
    found = graph.communities(edges)
    papers = table(spark, folder, "master")
    written = papers.select("rec_id", F.explode(people.network_names(F.col("authors_list"))).alias("node"))
    return edges, found, papers, graph.documents_of(found, written, papers)


@query()
def l_community_profiles(spark, folder):
    """Communities of co-authors with twenty papers or more: size, year, and what stands out in them."""
    _, found, papers, documents = _communities(spark, folder)
    rows = documents.join(papers.select("rec_id", F.col("abm_topic").alias("topic"), F.col("year_num").alias("year"), F.col("countries").alias("country")), "rec_id").withColumnRenamed("rec_id", "document")
    sizes = found.groupBy("community").agg(F.count("*").alias("members"))
    return lift.profiles(rows, sizes, "community", "topic", "country")


@query()
def l_community_agents(spark, folder):
    """The three kinds of agent of the largest lift in each community, among those of three papers or more."""
    _, _, papers, documents = _communities(spark, folder)
    rows = documents.join(papers.select("rec_id", F.explode(labels.agent_kinds(F.col("agent_category_label"))).alias("kind")), "rec_id")
    return lift.signatures(lift.lifts(rows, "community", "kind", "rec_id"), "community", "kind", 3, 0.0, 3, 0)


@query()
def l_heatmap(spark, folder):
    """Lifts of the leading keywords in each topic."""
    rows = table(spark, folder, "master").where("abm_topic is not null").select("rec_id", F.col("abm_topic").alias("topic"), F.explode("keywords_list").alias("keyword"))
    return lift.heatmap(lift.lifts(rows, "topic", "keyword", "rec_id"), "topic", "keyword", 5, 6, 18, 20.0)


@query()
def l_composition(spark, folder):
    """The three leading countries, topics and kinds of agents of each community, each counted once a paper."""
    _, _, papers, documents = _communities(spark, folder)
    fields = (("country", F.col("countries")), ("topic", F.array_compact(F.array("abm_topic"))), ("kind", labels.agent_kinds(F.col("agent_category_label"))))
    rows = None
    for name, values in fields:
        part = documents.join(papers.select("rec_id", F.explode(values).alias("value")), "rec_id").select("community", "rec_id", F.lit(name).alias("field"), "value")
        rows = part if rows is None else rows.unionByName(part)
    one = rows.withColumn("group", F.struct("community", "field"))
    return lift.composition(one, "group", "rec_id", "value", 3).select("group.community", "group.field", "value", "n", "rank")


@query()
def l_leading_members(spark, folder):
    """The five members of each community of the largest weighted degree."""
    edges, found, _, _ = _communities(spark, folder)
    degree = graph.degrees(edges).withColumn("weighted_degree", F.round("weighted_degree", 6)).join(found, "node")
    return ranking.top_in_group(degree, ["community"], [F.desc("weighted_degree"), "node"], 5).select("community", "node", "degree", "weighted_degree", "rank")


@query()
def g_author_modularity(spark, folder):
    """Modularity of the co-authors' communities, with and without weights."""
    edges = graph.pruned(_author_edges(spark, folder), 3)
    found = graph.communities(edges)
    return graph.modularity(edges, found).withColumn("kind", F.lit("weighted")).unionByName(graph.modularity(edges, found, False).withColumn("kind", F.lit("plain")))


@query()
def g_author_centrality(spark, folder):
    """Eigenvector centrality of the authors, and betweenness of those with ten co-authors or more (500 sources)."""
    edges = _author_edges(spark, folder)
    central = graph.eigenvector_centrality(edges)
    between = graph.betweenness(graph.pruned(edges, 10), sources=500)
    return central.join(between, "node", "left").select("node", F.round("centrality", 6).alias("centrality"), F.round("betweenness", 6).alias("betweenness"))
