"""Every query by name, and the SQL that an independent engine runs to the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import evaluate, graph, inventory, keywords, lexical, ranking, select, usage
from . import bindings as b
from .retrieval import rank_pool

TASK = "find worthless trash and pathetic text of src3 in en"
KEYWORD_TASK = "where is the tionally ething and charset of dreaming"
GRAPH_TASK = "urgent red widget of order"
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
BUDGET = 4000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _longs(sql: str) -> str:
    """count_if(...) as a long: the other engine makes it a wider integer."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 1, k + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:k], sql[k:end], "::bigint"]
        at = end
    return "".join([*out, sql[at:]])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = _longs(sql)
        return f

    return add


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g')), '([\p{{L}}\p{{N}}]+)', 1)"


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TERMS, KEYWORDS, GRAPH_TERMS = text.query_terms(TASK), text.keywords_of(KEYWORD_TASK), [t for t in text.query_terms(GRAPH_TASK) if len(t) > 1]

# --- lexical ranking over documents -------------------------------------------------------------------------------------

DOCS = f"""d as (select doc_id id, concat_ws('/', source, lang) file, doc_id::int line, {tok("text")} identifiers, {tok("substring(text, 1, 300)")} signature, {tok("concat_ws('/', source, lang)")} path from documents),
f as (select *, identifiers[1:8] as name, list_filter(identifiers, lambda x: regexp_matches(x, '[0-9]')) literals from d)"""


def _field(f: str) -> str:
    tf, w = f"len(list_filter({f}, lambda x: x = t))", scoring.FIELD_WEIGHTS[f]
    return f"case when {tf} > 0 then {w}.0 * ({tf} * 2.2 / ({tf} + 1.2 * (1 - 0.75 + 0.75 * (len({f}) / greatest(a_{f}, 1.0))))) else 0 end"


ANY = " or ".join(f"list_contains({f}, t)" for f in lexical.FIELDS)
SCORED = f"""with {DOCS}, q as (select unnest({sql_list(TERMS)}) t), s as (select count(*) n, {", ".join(f"avg(len({f})) a_{f}" for f in lexical.FIELDS)} from f),
df as (select t, count(*) df from f, q where {ANY} group by t),
sc as (select id, file, line,
 round(sum(case when df > 0 then ln(1 + (n - df + 0.5) / (df + 0.5)) * ({" + ".join(_field(f) for f in lexical.FIELDS)}) else 0 end), 6) bm25,
 sum(case when list_contains(name, t) then 6.0 else 0 end + case when list_contains(identifiers, t) then 2.0 else 0 end + case when list_contains(literals, t) then 2.0 else 0 end
  + case when contains(array_to_string(name, ' '), t) or contains(array_to_string(signature, ' '), t) or contains(array_to_string(literals, ' '), t) then 0.5 else 0 end)::double exact,
 sum(case when list_contains(path, t) then 3.0 else 0 end + case when len(list_filter(path, lambda p: contains(p, t))) > 0 then 0.5 else 0 end)::double path_score
 from f cross join q cross join s left join df using (t) group by id, file, line)"""
FUSED = SCORED + """,
b as (select id, row_number() over (order by bm25 desc, file, line, id) r from sc where bm25 > 0), e as (select id, row_number() over (order by exact desc, file, line, id) r from sc where exact > 0),
p as (select id, row_number() over (order by path_score desc, file, line, id) r from sc where path_score > 0),
fused as (select sc.*, b.r bm25_rank, e.r exact_rank, p.r path_rank, round(coalesce(1 / (60 + b.r), 0) + coalesce(1 / (60 + e.r), 0) + coalesce(1 / (60 + p.r), 0), 9) rrf
 from sc left join b using (id) left join e using (id) left join p using (id) where b.r is not null or e.r is not null or p.r is not null)"""
BEST = "order by rrf desc, bm25 desc, exact desc, path_score desc, file, line, id"


@query(f"select doc_id, len({tok('text')})::bigint n_tokens, ceil(length(text) / 4)::bigint estimate from documents")
def token_estimate(spark, sf_dir):
    """F1, F6."""
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), text.estimate(F.col("text")).alias("estimate"))


@query(f"with {DOCS} select count(*) n, {', '.join(f'round(avg(len({f})), 6) avg_{f}' for f in lexical.FIELDS)} from f")
def field_avg_len(spark, sf_dir):
    """A1."""
    return lexical.averages(b.fields(spark, sf_dir)).select("n", *[F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in lexical.FIELDS])


@query(f"with {DOCS} select term, count(*) df from (select unnest(list_distinct(list_concat(name, path, signature, identifiers, literals))) term from f) group by term")
def doc_freq(spark, sf_dir):
    """A2."""
    return lexical.document_terms(b.fields(spark, sf_dir))


@query(f"with {DOCS} select id, 'identifiers' as field, term, count(*) tf from (select id, unnest(identifiers) term from f) group by id, term having count(*) > 5")
def term_freq(spark, sf_dir):
    """A3."""
    return lexical.term_frequencies(b.fields(spark, sf_dir)).where("field = 'identifiers' and tf > 5")


@query()
def term_freq_fields(spark, sf_dir):
    """A3 over all five fields, whatever the count; term_freq is the part that its SQL covers."""
    return lexical.term_frequencies(b.fields(spark, sf_dir))


@query(SCORED + " select id, bm25 from sc where bm25 > 0")
def lexical_bm25(spark, sf_dir):
    """F13, F14, Q1."""
    return lexical.scores(b.fields(spark, sf_dir), TASK).where("bm25 > 0").select("id", "bm25")


@query(SCORED + " select id, exact from sc where exact > 0")
def lexical_exact(spark, sf_dir):
    return lexical.scores(b.fields(spark, sf_dir), TASK).where("exact > 0").select("id", "exact")


@query(SCORED + " select id, path_score from sc where path_score > 0")
def lexical_path(spark, sf_dir):
    return lexical.scores(b.fields(spark, sf_dir), TASK).where("path_score > 0").select("id", "path_score")


@query(FUSED + f" select id, file, bm25, exact, path_score, rrf, (row_number() over ({BEST}))::int as place from fused {BEST} limit 64")
def lexical_rrf(spark, sf_dir):
    """W1, W2, A4, G1, Q1."""
    top = lexical.rank(b.fields(spark, sf_dir), TASK)
    return top.select("id", "file", "bm25", "exact", "path_score", "rrf", F.row_number().over(Window.orderBy(*lexical.order())).alias("place"))


@query(FUSED + " select id, coalesce(bm25_rank, 0)::int bm25_rank, coalesce(exact_rank, 0)::int exact_rank, coalesce(path_rank, 0)::int path_rank from fused")
def lexical_ranks(spark, sf_dir):
    """Ranks over all rows with a signal; 0 where a row lacks one."""
    f = lexical.fuse(lexical.scores(b.fields(spark, sf_dir), TASK))
    return f.select("id", *[F.coalesce(c, F.lit(0)).alias(to) for c, to in (("bm25_rank", "bm25_rank"), ("exact_rank", "exact_rank"), ("path_score_rank", "path_rank"))])


@query(FUSED + " select file, max(rrf) score from fused group by file")
def lexical_file_max(spark, sf_dir):
    """A5."""
    return lexical.file_scores(lexical.fuse(lexical.scores(b.fields(spark, sf_dir), TASK)))


@query(FUSED + f", t as (select file, row_number() over ({BEST}) r from fused), u as (select file, min(r) r from t group by file), l as (select file from u order by r limit 4), c as (select distinct concat_ws('/', source, lang) file from documents where lang = 'fr') select file from l where file not in (select file from c)")
def rescue_anti_join(spark, sf_dir):
    """Files of the strongest matches that aren't among the candidates yet."""
    fused = lexical.fuse(lexical.scores(b.fields(spark, sf_dir), TASK))
    lead = fused.groupBy("file").agg(F.min(F.struct((-F.col("rrf")).alias("a"), (-F.col("bm25")).alias("b"), (-F.col("exact")).alias("c"), (-F.col("path_score")).alias("d"), "line", "id")).alias("best"))
    top = lead.orderBy("best.a", "best.b", "best.c", "best.d", "file").limit(4)
    have = b.table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.concat_ws("/", "source", "lang").alias("file")).distinct()
    return top.join(have, "file", "left_anti").select("file")


@query("with s as (select source, row_number() over (order by count(*) desc, source) place from documents group by source), d as (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) turn from documents) select doc_id, d.source, turn::int turn from d join s using (source) order by turn, place limit 256")
def interleave_round_robin(spark, sf_dir):
    """W3."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    place = d.groupBy("source").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")))
    return ranking.interleave(d.join(place, "source"), "source", "place", [F.desc("n_chars"), F.asc("doc_id")], 256).select("doc_id", "source", "turn")


# --- keywords over pages -------------------------------------------------------------------------------------------------

MATCH = "(w = t or (length(t) >= 4 and starts_with(w, t)))"
LINES = rf"""l0 as (select url file, string_split(replace(replace(html, '<', chr(10) || '<'), chr(13) || chr(10), chr(10)), chr(10)) ls from pages),
l1 as (select file, unnest(list_slice(list_filter(list_transform(ls, lambda x, i: {{'line': i, 'text': trim(x)}}), lambda z: length(z.text) > 0 and length(z.text) <= 400 and not regexp_matches(z.text, '^(//|/\*|\*|<!--|import\b|export\s*\{{|\}}?\s*from\s)')), 1, 3000)) z from l0),
l as (select file, z.line::int line, substring(z.text, 1, 200) text from l1),
h as (select *, list_filter({sql_list(KEYWORDS)}, lambda t: len(list_filter({tok("text")}, lambda w: {MATCH})) > 0) found from l),
m as (select * from h where len(found) > 0)"""


@query(f"with {LINES} select file, line, len(found)::int n from m")
def keyword_lines(spark, sf_dir):
    """Lines with a keyword."""
    return keywords.matching_lines(keywords.text_lines(b.page_files(spark, sf_dir)), KEYWORDS).select("file", "line", F.size("found").alias("n"))


def _matches(spark, sf_dir):
    files = b.page_files(spark, sf_dir)
    kinds = files.select("file", F.lit("text").alias("kind"))
    return keywords.file_matches(keywords.text_lines(files), KEYWORDS, kinds)


@query(rf"""with {LINES}, r as (select *, row_number() over (partition by file order by len(found) desc, line) r from m),
g as (select file, flatten(list(found)) ft, list(line order by line) filter (where r <= 3) best from r group by file),
p as (select url file, list_filter({sql_list(KEYWORDS)}, lambda t: len(list_filter({tok("url")}, lambda w: {MATCH})) > 0) ip from pages where not regexp_matches(url, '{text.TEST_FILE}')),
j as (select p.file, list_filter({sql_list(KEYWORDS)}, lambda t: list_contains(list_concat(ip, coalesce(ft, [])), t)) terms, coalesce(len(best), 0)::int n_lines, best from p left join g using (file) where best is not null or len(ip) > 0)
select file, array_to_string(terms, ' ') terms, n_lines, coalesce(array_to_string(best, ' '), '') best_lines from j order by len(terms) desc, n_lines desc, file limit 6""")
def keyword_matches(spark, sf_dir):
    """Q2, W5, W6."""
    best = keywords.best_matches(_matches(spark, sf_dir), KEYWORDS)
    return best.select("file", F.array_join("terms", " ").alias("terms"), "n_lines", F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<line:int,text:string>>")), lambda x: x["line"].cast("string")), " ").alias("best_lines"))


@query(f"with {LINES} select t term from (select unnest({sql_list(KEYWORDS)}) t) where t not in (select unnest(found) from m)")
def keyword_missing(spark, sf_dir):
    """U3."""
    found = keywords.matching_lines(keywords.text_lines(b.page_files(spark, sf_dir)), KEYWORDS).select(F.explode("found").alias("term"))
    return keywords.missing_terms(found, KEYWORDS)


@query(rf"select item_id, array_to_string(list_filter(list_distinct_in_order, lambda w: true), ' ') terms from (select item_id, list_filter(list_transform(t, lambda x, i: case when list_position(t, x) = i then x end), lambda x: x is not null) list_distinct_in_order from (select item_id, list_filter({tok('text')}, lambda w: length(w) > 2 and regexp_full_match(w, '[a-z][a-z0-9]*') and not list_contains({sql_list(dict.fromkeys((*text.STOP_WORDS, *text.FILLER_WORDS)))}, w)) t from benchmark))")
def keyword_terms(spark, sf_dir):
    """F4."""
    return b.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.keyword_terms(F.col("text")), " ").alias("terms"))


# --- the typed graph -----------------------------------------------------------------------------------------------------

NODES = """n as (select 'c:' || c_custkey id, c_name as name, 'customer/' || c_mktsegment file, c_custkey::bigint line from customer union all select 'o:' || o_orderkey, 'order ' || o_orderkey, 'orders/' || o_orderstatus, o_orderkey from orders
 union all select 'p:' || p_partkey, p_name, 'part/' || p_brand, p_partkey from part union all select 's:' || s_suppkey, s_name, 'supplier/' || s_nationkey, s_suppkey from supplier
 union all select 'n:' || n_nationkey, n_name, 'nation', n_nationkey from nation union all select 'r:' || r_regionkey, r_name, 'region', r_regionkey from region)"""
EDGES = """e as (select o_orderkey::bigint seq, 'c:' || o_custkey src_id, 'o:' || o_orderkey dst_id, 'call' kind, o_orderpriority site_text from orders union all select l_linenumber, 'o:' || l_orderkey, 'p:' || l_partkey, 'call', l_returnflag from lineitem
 union all select l_linenumber, 'o:' || l_orderkey, 's:' || l_suppkey, 'method', l_returnflag from lineitem union all select 0, 'c:' || c_custkey, 'n:' || c_nationkey, 'type', c_mktsegment from customer union all select 0, 'n:' || n_nationkey, 'r:' || n_regionkey, 'type', '' from nation)"""


def hits(*columns: str) -> str:
    hay = rf"lower(regexp_replace(concat_ws(' ', {', '.join(columns)}), '([a-z0-9])([A-Z])', '\1 \2', 'g'))"
    return "(" + " + ".join(f"contains({hay}, '{t}')::int" for t in GRAPH_TERMS) + ")"


def _ids(df, key, prefix):
    return df.select(F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("id"))


@query(f"with {EDGES} select src_id lead_id, dst_id, kind, seq from e where src_id like 'o:%' qualify row_number() over (partition by src_id, dst_id order by seq desc, kind desc, site_text desc) = 1")
def one_hop_forward(spark, sf_dir):
    """J11 for every order."""
    return graph.forward(_ids(b.table(spark, sf_dir, "orders"), "o_orderkey", "o"), b.edges(spark, sf_dir)).select("lead_id", "dst_id", "kind", "seq")


@query(f"with {NODES}, {EDGES}, x as (select dst_id lead_id, src_id, kind, site_text from e where dst_id like 'p:%' qualify row_number() over (partition by dst_id, src_id order by seq, kind, site_text) = 1), s as (select lead_id, src_id, {hits('n.name', 'n.file', 'site_text')} task_score from x join n on n.id = src_id) select lead_id, src_id, task_score, (row_number() over (partition by lead_id order by task_score desc, src_id))::int as rank from s qualify rank <= 12")
def one_hop_reverse_topk(spark, sf_dir):
    """J12, W4, F8, F9 for every part: its 12 callers most about the task (one kind, so one prior)."""
    leads = _ids(b.table(spark, sf_dir, "part"), "p_partkey", "p")
    return graph.reverse_top(leads, b.edges(spark, sf_dir), b.nodes(spark, sf_dir), GRAPH_TERMS).select("lead_id", "src_id", "task_score", "rank")


@query(f"with {EDGES}, u as (select dst_id lead_id, src_id caller, min(seq) s1 from e where dst_id like 'p:%' group by all), w as (select caller, dst_id sibling_id, seq s2 from u2 join (select src_id caller, dst_id, seq, kind from e) using (caller) where kind in ('call', 'method', 'import')), z as (select lead_id, sibling_id, min(row(s1, s2)) seen from u join w using (caller) where sibling_id <> lead_id group by all) select lead_id, sibling_id, (row_number() over (partition by lead_id order by seen, sibling_id))::int as rank from z qualify rank <= 4".replace("from u2 join (select src_id caller, dst_id, seq, kind from e) using (caller)", "from (select src_id caller, dst_id, seq, kind from e)"))
def siblings(spark, sf_dir):
    """J15 for every part, all declarations in one file."""
    leads = _ids(b.table(spark, sf_dir, "part"), "p_partkey", "p")
    return graph.siblings(leads, b.edges(spark, sf_dir), b.nodes(spark, sf_dir, one_file=True))


@query(f"with {NODES}, {EDGES}, c as (select * from e where kind in ('call', 'method', 'import')), t as (select a.src_id lead_id, c.dst_id callee_id, min(row(a.seq, c.seq, a.dst_id, c.site_text)) f from c a join c on c.src_id = a.dst_id where a.src_id like 'c:%' group by all), x as (select t.* from t where not exists (select 1 from e where e.src_id = t.lead_id and e.dst_id = t.callee_id)), s as (select lead_id, callee_id, f[3] via, {hits('n.name', 'n.file', 'f[4]')} task_score, f from x join n on n.id = callee_id) select lead_id, callee_id, via, task_score, 0.58::double prior, (row_number() over (partition by lead_id order by task_score desc, row(f[1], f[2], f[3]), callee_id))::int as rank from s qualify rank <= 4")
def nested_callees(spark, sf_dir):
    """J16 for every customer: parts and suppliers of its orders."""
    leads = _ids(b.table(spark, sf_dir, "customer"), "c_custkey", "c")
    return graph.nested_callees(leads, b.edges(spark, sf_dir), b.nodes(spark, sf_dir), GRAPH_TERMS)


@query(f"with {NODES}, rd as (select distinct 'o:' || l_orderkey node_id, l_partkey || '#' || l_linenumber symbol from lineitem), nr as (select * from rd where symbol in (select symbol from rd group by symbol having count(*) <= 40)), o as (select a.node_id lead_id, symbol, z.node_id reader_id from nr a join nr z using (symbol) where a.node_id <> z.node_id), p as (select o.*, x.file lead_file, y.file reader_file from o join n x on x.id = lead_id join n y on y.id = reader_id), f as (select *, row_number() over (partition by lead_id, symbol order by lead_file = reader_file, reader_file, reader_id) r from p qualify r <= 3), d as (select lead_id, reader_id, min(row(symbol, r)) s from f group by all) select lead_id, s[1] symbol, reader_id, (row_number() over (partition by lead_id order by s, reader_id))::int as rank from d qualify rank <= 6")
def shared_readers(spark, sf_dir):
    """J14 for every order: others with the same part on the same line number."""
    items = b.table(spark, sf_dir, "lineitem")
    reads = items.select(F.concat(F.lit("o:"), "l_orderkey").alias("node_id"), F.concat("l_partkey", F.lit("#"), "l_linenumber").alias("symbol"))
    leads = _ids(b.table(spark, sf_dir, "orders"), "o_orderkey", "o")
    return graph.shared_readers(leads, reads, b.nodes(spark, sf_dir))


@query(f"with {EDGES}, b as (select src_id a, dst_id b from e union select dst_id, src_id from e), l as (select 's:' || s_suppkey node from supplier where s_acctbal < 0), h1 as (select distinct b.b node from l join b on b.a = l.node where b.b not in (select node from l)), h2 as (select distinct b.b node from h1 join b on b.a = h1.node where b.b not in (select node from l union select node from h1)) select 'p:' || p_partkey target_id, case when h1.node is not null then 1 when h2.node is not null then 2 else -1 end::int distance from part left join h1 on h1.node = 'p:' || p_partkey left join h2 on h2.node = 'p:' || p_partkey")
def hop_distance_2(spark, sf_dir):
    """From suppliers in debt, taken together, to every part; -1 beyond two steps. For each lead: lead_distance_2."""
    leads = _ids(b.table(spark, sf_dir, "supplier").where("s_acctbal < 0"), "s_suppkey", "s")
    found = graph.hop_distance(leads, _ids(b.table(spark, sf_dir, "part"), "p_partkey", "p"), b.edges(spark, sf_dir))
    return found.select("target_id", F.coalesce("distance", F.lit(-1)).alias("distance"))


@query(f"""with {EDGES}, l as (select 's:' || s_suppkey lead_id from supplier where s_acctbal < 5000), g as (select 'p:' || p_partkey node from part where p_partkey % 97 = 0 union all select 'o:' || o_orderkey from orders where o_orderkey % 997 = 0),
ways as (select src_id here, dst_id node, 0 back, seq from e union all select dst_id, src_id, 1, seq from e),
near as (select lead_id, node, min(struct_pack(back := back, seq := seq)) met from l join ways on here = lead_id where node <> lead_id group by lead_id, node),
onward as (select lead_id, node here from near qualify row_number() over (partition by lead_id order by met.back, met.seq, node) <= 254),
steps as (select lead_id, lead_id node, 0 d from l union all select lead_id, node, 1 from near union all select lead_id, node, 2 from onward join ways using (here)),
f as (select lead_id, min(d) d from steps join g using (node) group by lead_id)
select lead_id, d::int distance from l left join f using (lead_id)""")
def lead_distance_2(spark, sf_dir):
    """From each supplier with a small balance to the nearest of some parts and orders, two steps at most, 256 nodes met."""
    leads = _ids(b.table(spark, sf_dir, "supplier").where("s_acctbal < 5000"), "s_suppkey", "s")
    targets = _ids(b.table(spark, sf_dir, "part").where("p_partkey % 97 = 0"), "p_partkey", "p").unionByName(_ids(b.table(spark, sf_dir, "orders").where("o_orderkey % 997 = 0"), "o_orderkey", "o"))
    return graph.lead_distance(leads, targets, b.edges(spark, sf_dir))


@query(f"with {EDGES}, b as (select src_id a, dst_id b from e union select dst_id, src_id from e), c as (select 'o:' || o_orderkey node from orders where o_orderpriority = '1-URGENT') select 'c:' || c_custkey target_id, exists (select 1 from b join c on c.node = b.b where b.a = 'c:' || c_custkey) reached from customer")
def soft_candidate_recall(spark, sf_dir):
    """Customers with an urgent order."""
    urgent = _ids(b.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "o_orderkey", "o")
    return graph.soft_recall(_ids(b.table(spark, sf_dir, "customer"), "c_custkey", "c"), urgent, b.edges(spark, sf_dir))


@query("select 'p:' || l_partkey node_id, min(l_linenumber)::int depth, min_by(l_returnflag, (l_orderkey, l_linenumber, l_suppkey, l_returnflag)) first_kind, count(distinct l_suppkey) n_leads, max(l_discount) structural, nullif(max(l_tax), 0) semantic, min_by('o:' || l_orderkey, (l_linenumber, l_orderkey, l_suppkey, l_returnflag)) via from lineitem group by l_partkey")
def node_merge(spark, sf_dir):
    """A part reached over its line items."""
    i = b.table(spark, sf_dir, "lineitem")
    found = i.select(F.concat(F.lit("p:"), "l_partkey").alias("node_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").alias("seq"), F.col("l_linenumber").alias("depth"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("s:"), "l_suppkey").alias("lead_id"), F.lit("compiler").alias("source"), F.concat(F.lit("o:"), "l_orderkey").alias("via"), F.lit(None).cast("string").alias("site_text"), F.col("l_discount").alias("structural"), F.col("l_tax").alias("semantic"))
    m = graph.merge_nodes(found)
    return m.select("node_id", "depth", F.col("kinds")[0].alias("first_kind"), F.size("lead_ids").cast("long").alias("n_leads"), "structural", "semantic", "via")


SPANS = "sp as (select 's' || source || ':' || id id, source, st, en from (select source, doc_id id, (doc_id // 20 * 10)::bigint st, (doc_id // 20 * 10 + 5 + doc_id % 31)::bigint en from documents))"


@query(f"with {SPANS} select doc_id entry_id, id node_id from documents d join sp on sp.source = d.source and sp.st <= d.doc_id % 997 and sp.en >= d.doc_id % 997 qualify row_number() over (partition by doc_id order by en - st, id) = 1")
def entry_locate_range(spark, sf_dir):
    """The smallest span of a source that holds a line."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", "source")
    st = F.floor(F.col("doc_id") / 20) * 10
    spans = d.select(F.concat(F.lit("s"), "source", F.lit(":"), "doc_id").alias("id"), F.col("source").alias("file"), st.alias("start_line"), (st + 5 + F.col("doc_id") % 31).alias("end_line"))
    entries = d.select(F.col("doc_id").alias("entry_id"), F.col("source").alias("file"), (F.col("doc_id") % 997).alias("line"), F.lit(None).cast("long").alias("end_line"))
    return graph.locate(entries, spans)


# --- selection under budgets ---------------------------------------------------------------------------------------------

FOLD = "list_reduce(list_prepend({{'u': 0::bigint, 'n': 0, 'k': 0::bigint, 'c': 0::bigint, 's': 0::bigint}}, list({{'u': 0::bigint, 'n': 0, 'k': key, 'c': c, 's': s}} order by {order})), lambda a, x: {step})"


def fold_sql(order: str, step: str) -> str:
    return FOLD.format(order=order, step=step)


ITEMS = "it as (select 'o:' || o_orderkey id, o_custkey grp, o_orderkey key, o_totalprice p, (o_totalprice / 100)::bigint c, (o_totalprice / 1000)::bigint s from orders)"


@query(f"with {ITEMS.replace('(o_totalprice / 100)::bigint', 'floor(o_totalprice / 100)::bigint').replace('(o_totalprice / 1000)::bigint', 'floor(o_totalprice / 1000)::bigint')} select grp, r.u used, r.n n from (select grp, {fold_sql('p desc, key', 'case when a.u + x.c <= 4000 then struct_pack(u := a.u + x.c, n := a.n + 1, k := x.k, c := x.c, s := x.s) else struct_pack(u := a.u, n := a.n, k := a.k, c := a.c, s := a.s) end')} r from it group by grp)")
def budget_fold(spark, sf_dir):
    """Of each customer's orders, dearest first, those that fit."""
    o = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("key"), (-F.col("o_totalprice")).alias("p"), F.floor(F.col("o_totalprice") / 100).alias("c"))
    return select.budget_fold(o, "grp", ["p", "key"], "key", "c", BUDGET).select("grp", "used", F.size("ids").alias("n"))


@query(f"with {ITEMS.replace('(o_totalprice / 100)::bigint', 'floor(o_totalprice / 100)::bigint').replace('(o_totalprice / 1000)::bigint', 'floor(o_totalprice / 1000)::bigint')} select grp, r.u used, r.n n from (select grp, {fold_sql('p desc, key', 'case when a.n < 8 and a.u + x.c <= 4000 then struct_pack(u := a.u + x.c, n := a.n + 1, k := x.k, c := x.c, s := x.s) when a.n < 8 and a.u + x.s <= 4000 then struct_pack(u := a.u + x.s, n := a.n + 1, k := x.k, c := x.c, s := x.s) else struct_pack(u := a.u, n := a.n, k := a.k, c := a.c, s := a.s) end')} r from it group by grp)")
def neighborhood_cap(spark, sf_dir):
    """A body or else a signature, 8 rows at most."""
    o = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("key"), (-F.col("o_totalprice")).alias("p"), F.floor(F.col("o_totalprice") / 100).alias("c"), F.floor(F.col("o_totalprice") / 1000).alias("s"))
    return select.capped_fold(o, "grp", ["p", "key"], "key", "c", "s", BUDGET, most=8).select("grp", "used", "n")


PLACED = "struct(id varchar, file varchar, lo bigint, hi bigint, fl bigint, br bigint, grows boolean, level varchar)[]"
IN_BODY = "len(list_filter(placed, lambda z: z.level = 'body' and z.file = t.file and z.lo <= t.lo and z.hi >= t.hi)) > 0"
BACK = "list_sum(list_concat([0::bigint], list_transform(list_filter(placed, lambda z: z.level = 'body' and z.file = t.file and t.lo <= z.lo and t.hi >= z.hi), lambda z: z.fl)))::bigint"
#: The same two passes, a step of recursion for each item.
ALLOCATION = f"""with recursive it as (select o_custkey task, 'o:' || o_orderkey id, o_orderstatus file, o_orderkey % 50 lo, o_orderkey % 50 + o_orderkey % 7 hi, floor(o_totalprice / 100)::bigint fl, floor(o_totalprice / 1000)::bigint br, o_orderkey % 3 depth, o_orderkey % 11 = 0 outl,
  row_number() over (partition by o_custkey order by o_totalprice / 1e6 desc, o_orderkey % 3, 'o:' || o_orderkey) k from orders),
walk as (select distinct task, 0::bigint k, 0::bigint used, []::{PLACED} placed from it
 union all select task, k, used + case level when 'body' then fl - back when 'signature' then br else 0 end,
  list_concat(list_transform(placed, lambda z: struct_pack(id := z.id, file := z.file, lo := z.lo, hi := z.hi, fl := z.fl, br := z.br, grows := z.grows, level := case when u.level = 'body' and z.level = 'body' and z.file = u.file and u.lo <= z.lo and u.hi >= z.hi then 'covered' else z.level end)),
   [struct_pack(id := id, file := file, lo := lo, hi := hi, fl := fl, br := br, grows := not (depth = 1 and outl and fl > 800), level := level)])
  from (select *, case when inside then 'covered' when not (depth = 1 and outl and fl > 800) and used - back + fl <= 4000 then 'body' when used + br <= 4000 then 'signature' else 'omitted' end as level
   from (select t.*, w.used, w.placed, {IN_BODY} inside, {BACK} back from walk w join it t on t.task = w.task and t.k = w.k + 1) v) u),
n as (select task, max(k) n from walk group by task), one as (select w.* from walk w join n on n.task = w.task and n.n = w.k),
grow as (select task, 0::bigint k, used, placed from one
 union all select task, k, used + case when fits then t.fl - t.br else 0 end,
  list_transform(placed, lambda z: struct_pack(id := z.id, file := z.file, lo := z.lo, hi := z.hi, fl := z.fl, br := z.br, grows := z.grows, level := case when fits and z.id = v.t.id then 'body' else z.level end))
  from (select *, t.level = 'signature' and t.grows and used + t.fl - t.br <= 4000 and len(list_filter(placed, lambda z: z.level = 'body' and z.file = t.file and ((z.lo <= t.lo and z.hi >= t.hi) or (t.lo <= z.lo and t.hi >= z.hi)))) = 0 fits
   from (select g.task, g.k + 1 k, g.used, g.placed, o.placed[g.k + 1] t from grow g join one o on o.task = g.task where g.k < len(g.placed)) r) v)
select task, e.id, k::int place, e.level as level, used from (select g.task, g.used, unnest(g.placed) e, unnest(generate_series(1, len(g.placed))) k from grow g join n on n.task = g.task and n.n = g.k)"""


def _order_items(spark, sf_dir):
    o, key = b.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("task"), F.concat(F.lit("o:"), key).alias("id"), F.col("o_orderstatus").alias("file"), (key % 50).alias("start_line"), (key % 50 + key % 7).alias("end_line"), F.floor(F.col("o_totalprice") / 100).alias("body_tokens"), F.floor(F.col("o_totalprice") / 1000).alias("signature_tokens"), (key % 3).alias("depth"), (F.col("o_totalprice") / 1e6).alias("structural"), (F.col("o_totalprice") / 1e6).alias("final"), F.lit(False).alias("external"), (key % 11 == 0).alias("outline"))


@query(ALLOCATION)
def budget_alloc_two_pass(spark, sf_dir):
    """Bodies and signatures of each customer's orders."""
    return select.allocate(_order_items(spark, sf_dir), "task", BUDGET)


FEW = "struct(id bigint, file varchar, said varchar, graph bigint[], score double)[]"
LEADS = """g as (select l_orderkey, list(distinct l_partkey) graph from lineitem group by l_orderkey),
it as (select o_custkey task, o_orderkey id, o_orderstatus file, o_orderpriority || chr(10) || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') said, graph, o_totalprice / 500000 score, row_number() over (partition by o_custkey order by (o_orderstatus = 'F')::int, o_totalprice / 500000 desc, o_orderstatus, o_orderkey) k
 from orders join g on o_orderkey = l_orderkey)"""
ALIKE = "z.said = t.said or len(list_intersect(z.graph, t.graph)) >= 0.5 * least(len(z.graph), len(t.graph))"
#: A step of recursion for each lead; what waits comes back first.
DIVERSITY = f"""with recursive {LEADS},
walk as (select distinct task, 0::bigint k, []::{FEW} taken, []::{FEW} waiting from it
 union all select task, k, case when len(back) >= 4 or alike then back else list_append(back, x) end, case when len(back) < 4 and alike then list_append(rest, x) else rest end
 from (select task, k, back, rest, x, len(list_filter(back, lambda z: {ALIKE.replace('t.', 'x.')})) > 0 alike
  from (select task, k, x, list_concat(taken, waiting[1:ahead]) back, waiting[ahead + 1:] rest
   from (select t.task, t.k, w.taken, w.waiting, struct_pack(id := t.id, file := t.file, said := t.said, graph := t.graph, score := t.score) x,
     least(4 - len(w.taken), coalesce(list_position(list_transform(w.waiting, lambda z: z.score - t.score > 0.1), false) - 1, len(w.waiting))) ahead
    from walk w join it t on t.task = w.task and t.k = w.k + 1) a) c) d),
n as (select task, max(k) n from walk group by task),
done as (select w.task, list_concat(taken, waiting[1:greatest(0, 2 - len(taken))]) taken from walk w join n on n.task = w.task and n.n = w.k)
select task, e.id, k::int place, e.score from (select task, unnest(taken) e, unnest(generate_series(1, len(taken))) k from done)"""


@query(DIVERSITY)
def diversity_leads(spark, sf_dir):
    """Of each customer's orders four that differ by their parts."""
    parts = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("graph"))
    o = b.table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    leads = o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("class"), F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("signature"), (F.col("o_totalprice") / 500000).alias("score"), "graph")
    return select.diverse(leads, "task")


@query("""with e as (select o_custkey task, l_suppkey lead, l_suppkey % 5 place, l_orderkey * 10 + l_linenumber as rk, case when l_linenumber % 3 = 0 then 'test' else 'caller' end kind, l_suppkey % 4 = 0 typed from lineitem join orders on l_orderkey = o_orderkey),
c as (select *, typed or count(*) over (partition by task, place, lead) > 2 narrow from e), f as (select * from c where not (kind = 'test' and narrow)),
p as (select *, row_number() over (partition by task, place, lead, kind order by rk) r from f), q as (select * from p where kind <> 'test' or r <= 1),
s as (select *, row_number() over (partition by task, kind order by place, lead, rk) a from q), w as (select * from s where kind <> 'test' or a <= 4),
x as (select *, row_number() over (partition by task, place, lead order by rk) i from w), y as (select * from x where i <= 2),
z as (select *, row_number() over (partition by task, narrow order by place, lead, rk) j from y)
select task, lead, rk, kind from z where not narrow or j <= 3""")
def caller_quota(spark, sf_dir):
    """Of the suppliers of a customer's items, tests and users within their limits."""
    items = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    e = items.select(F.col("o_custkey").alias("task"), supplier.alias("lead"), (supplier % 5).alias("place"), (F.col("l_orderkey") * 10 + line).alias("rank"), F.when(line % 3 == 0, "test").otherwise("caller").alias("kind"), (supplier % 4 == 0).alias("typed"))
    return select.caller_quota(e, "task", per_lead=1, fan_in=2, hub=2).select("task", "lead", F.col("rank").alias("rk"), "kind")


# --- evaluation against labels -------------------------------------------------------------------------------------------

SCORE = "round((('0x' || substring(md5(doc_id::varchar), 1, 6))::bigint)::double / 16777215, 6)"
ITEM = f"i as (select doc_id, lang case_id, source file, {SCORE} score, ceil(n_chars / 4)::bigint tokens, case when quality = 1 and toxic = 1 then 'signature' when quality = 1 then 'body' end wanted, quality from documents left join labels using (doc_id)), v as (select *, case when score > 0.5 then 'body' when score >= 0.3 then 'signature' else 'omitted' end level from i)"
OKAY = "(level = 'body' or (level = 'signature' and wanted = 'signature'))"


def _leveled(spark, sf_dir):
    return b.scored_items(spark, sf_dir).withColumn("level", scoring.level(F.col("score"), 0.5, 0.3))


def _case(spark, sf_dir):
    i = _leveled(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    items = i.select("case_id", "file", key.alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "level", F.lit(1).alias("depth"), "score", "tokens")
    gold = i.where(F.col("wanted").isNotNull()).select("case_id", "file", key.alias("name"), F.lit(None).cast("int").alias("line"), F.col("wanted").alias("required_level"), key.alias("target"))
    return i.select("case_id").distinct(), items, gold


RATIOS = "count(wanted) gold, count_if(level <> 'omitted') retrieved, count_if(level <> 'omitted' and wanted is not null) relevant, count_if(level = 'body' and wanted is not null) bodies, count_if(wanted is not null and " + OKAY + ") at_level, count_if(level = 'omitted' and wanted is not null) omitted_relevant, sum(case when level <> 'omitted' then tokens else 0 end)::bigint toks"
METRICS = f"with {ITEM}, g as (select case_id, {RATIOS} from v group by case_id), mm as (select case_id, gold, retrieved, relevant, omitted_relevant, case when retrieved = 0 then (gold = 0)::int::double else relevant / retrieved end as precision, case when gold = 0 then 1 else relevant / gold end recall, case when gold = 0 then 1 else bodies / gold end body_recall, case when gold = 0 then 1 else at_level / gold end required_level_recall, case when toks = 0 then 0 else relevant * 1000 / toks end per_1k from g)"


@query(METRICS + " select * from mm")
def precision_recall(spark, sf_dir):
    """A11, J9, F18."""
    return evaluate.scores(*_case(spark, sf_dir))


@query(METRICS + " select count(*) cases, round(avg(precision), 9) mean_precision, round(avg(recall), 9) mean_recall, round(avg(required_level_recall), 9) mean_required_level_recall from mm")
def macro_avg(spark, sf_dir):
    """A12, Q10."""
    m = evaluate.macro_average(evaluate.scores(*_case(spark, sf_dir)), ["precision", "recall", "required_level_recall"])
    return m.select("cases", *[F.round(c, 9).alias(c) for c in m.columns[1:]])


@query(f"with {ITEM} select case_id, count(*) targets, 1.0::double recall, count_if({OKAY}) / count(*) required_level_recall, coalesce(array_to_string(list(doc_id::varchar order by doc_id::varchar) filter (where not {OKAY}), ' '), '') missing from v where wanted is not null group by case_id")
def required_level_recall(spark, sf_dir):
    """A13, J8."""
    _, items, gold = _case(spark, sf_dir)
    return evaluate.required_context(items, gold).withColumn("missing", F.array_join("missing", " "))


@query(f"with {ITEM} select case_id, count(*) symbols, count(distinct file) files, count_if(level = 'body') bodies, count_if(level = 'signature') signatures, sum(tokens)::bigint tokens from v group by case_id")
def footprint(spark, sf_dir):
    """A14."""
    return evaluate.footprint(_case(spark, sf_dir)[1])


@query(f"with {ITEM}, r as (select case_id, quality = 1 good, row_number() over (partition by case_id order by score desc, doc_id) r from i), m as (select case_id, min(r) filter (where good) best from r group by case_id) select case_id, coalesce(best <= 1, false) hit_at_1, coalesce(best <= 3, false) hit_at_3, coalesce(best <= 5, false) hit_at_5, best is not null shortlist from m")
def hit_at_k(spark, sf_dir):
    """Leads are documents by score, entries those labelled good."""
    i = b.scored_items(spark, sf_dir)
    leads = i.select("case_id", F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "doc_id")).alias("rank"))
    entries = i.where("quality = 1").select("case_id", F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("end_line"))
    return evaluate.hit_at(leads, entries)


@query(f"with {ITEM}, r as (select case_id, file, min(doc_id % 4) filter (where quality = 1) depth from i group by case_id, file), c as (select file case_id, min(depth) depth from r group by file) select case_id, depth::int depth, coalesce(depth <= 1, false) within_1, coalesce(depth <= 2, false) within_2 from c")
def lead_recovery(spark, sf_dir):
    """A15 by source."""
    i = b.scored_items(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    items = i.select(F.col("file").alias("case_id"), key.alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), (F.col("doc_id") % 4).cast("int").alias("depth"))
    entries = i.where("quality = 1").select(F.col("file").alias("case_id"), key.alias("file"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("end_line"))
    return evaluate.lead_recovery(items, entries)


@query(f"with {ITEM}, t as (select unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::double threshold), x as (select threshold, wanted, case when score > threshold then 'body' when score >= 0.3 then 'signature' else 'omitted' end level from i, t) select threshold, count(*) items, count_if(level = 'body') bodies, count_if(level = 'signature') signatures, count(wanted) required, count_if(wanted is not null and {OKAY}) at_level, case when count(wanted) = 0 then 1 else count_if(wanted is not null and {OKAY}) / count(wanted) end recall from x group by threshold")
def threshold_sweep(spark, sf_dir):
    """A21."""
    return evaluate.threshold_sweep(b.scored_items(spark, sf_dir), THRESHOLDS)


RUNS = "select user_id, event_type, round(value / 400, 9) score from events"


@query(f"with r as ({RUNS}) select user_id, count(*) runs, round(avg(score), 9) mean, round(stddev_pop(score), 9) sd, min(score) low, max(score) high, round(max(score) - min(score), 9) as range, round(avg((score > 0.3)::int), 9) include_rate from r group by user_id")
def score_stability(spark, sf_dir):
    """A22."""
    r = b.table(spark, sf_dir, "events").select("user_id", F.round(F.col("value") / 400, 9).alias("score"))
    return evaluate.stability(r, ["user_id"], "score").select("user_id", "runs", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "low", "high", F.round("range", 9).alias("range"), F.round("include_rate", 9).alias("include_rate"))


@query(f"with {ITEM} select min(score) filter (where quality = 1) min_gold, max(score) filter (where quality = 0) max_noise, round(min(score) filter (where quality = 1) - max(score) filter (where quality = 0), 6) margin from i where quality is not null")
def separation_margin(spark, sf_dir):
    """A23."""
    i = b.scored_items(spark, sf_dir).where("quality is not null")
    return evaluate.separation(i, "score", F.col("quality") == 1).withColumn("margin", F.round("margin", 6))


@query("select event_type, b as budget, case when grouping(event_type) = 1 then 1 else 0 end::int overall, count(*) n, round(avg(value), 6) mean, round(coalesce(stddev_samp(value), 0), 6) sd from (select event_type, (2000 * (1 + event_id % 4))::bigint b, value from events) group by grouping sets ((event_type, b), (b))")
def sweep_grouping_sets(spark, sf_dir):
    """A18, A19."""
    e = b.table(spark, sf_dir, "events").select("event_type", (2000 * (1 + F.col("event_id") % 4)).alias("budget"), "value")
    s = evaluate.sweep(e, "budget", "event_type", "value")
    return s.select("event_type", "budget", "overall", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("select o_orderpriority, count_if(o_totalprice > avg_price) win, count_if(o_totalprice = avg_price) tie, count_if(o_totalprice < avg_price) loss from (select o_orderpriority, o_totalprice, min(o_totalprice) over (partition by o_custkey) avg_price from orders) group by o_orderpriority")
def win_tie_loss(spark, sf_dir):
    """Each order against its customer's cheapest one."""
    o = b.table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", F.min("o_totalprice").over(Window.partitionBy("o_custkey")).alias("base"))
    return evaluate.win_tie_loss(o, "o_orderpriority", "o_totalprice", "base")


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) a, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) z from orders) select o_custkey, count(*) targets, round(avg(a - z), 6) mean_gain from r group by o_custkey")
def rank_gain(spark, sf_dir):
    """W9, A20."""
    o = b.table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    r = o.select("o_custkey", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("a"), F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("z"))
    return r.groupBy("o_custkey").agg(F.count("*").alias("targets"), F.round(F.avg(F.col("a") - F.col("z")), 6).alias("mean_gain"))


@query("with a as (select o_custkey k from orders where o_orderstatus = 'F' group by 1), z as (select o_custkey k from orders where o_orderpriority = '1-URGENT' group by 1) select coalesce(a.k, z.k) custkey, case when z.k is null then 'dropped' else 'added' end change from a full join z on a.k = z.k where a.k is null or z.k is null")
def selection_changes(spark, sf_dir):
    """U5."""
    o = b.table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("a")).distinct()
    z = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("z")).distinct()
    j = a.join(z, F.col("a") == F.col("z"), "full").where("a is null or z is null")
    return j.select(F.coalesce("a", "z").alias("custkey"), F.when(F.col("z").isNull(), "dropped").otherwise("added").alias("change"))


@query("with g as (select l_orderkey k, l_linenumber t, l_partkey p, (l_suppkey % 40)::int st, (l_suppkey % 40 + l_linenumber + 3)::int en from lineitem), x as (select distinct k, t, p, st, en from g), d as (select l_orderkey k, (l_partkey % 40)::int ds, (l_partkey % 40 + 6)::int de from lineitem), u as (select *, unnest(generate_series(st, en)) line from x), f as (select k, t, p, st, count(*) found, min(line) f1 from u where exists (select 1 from d where d.k = u.k and line between ds and de) group by all) select x.k case_id, x.t || ':' || x.p || ':' || x.st target, (en - x.st + 1)::int lines, coalesce(found, 0)::bigint found, coalesce(f1 = x.st, false) and coalesce(found, 0) >= 0.9 * (en - x.st + 1) covered from x left join f on f.k = x.k and f.t = x.t and f.p = x.p and f.st = x.st")
def delivered_coverage(spark, sf_dir):
    """Q11: line ranges of each order's items against those delivered for it."""
    i = b.table(spark, sf_dir, "lineitem")
    st = (F.col("l_suppkey") % 40).cast("int")
    gold = i.select(F.col("l_orderkey").alias("case_id"), F.concat_ws(":", "l_linenumber", "l_partkey", st).alias("target"), F.lit("f").alias("file"), st.alias("start_line"), (st + F.col("l_linenumber") + 3).alias("end_line")).distinct()
    ds = (F.col("l_partkey") % 40).cast("int")
    got = i.select(F.col("l_orderkey").alias("case_id"), F.lit("f").alias("file"), ds.alias("start_line"), (ds + 6).alias("end_line"))
    return evaluate.delivered_coverage(got, gold)


@query("with n as (select doc_id, source || '.' || lang as name from documents), t as (select doc_id, text from documents) select doc_id case_id, name, contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), regexp_replace(lower(string_split(name, '.')[-1]), '[^a-z0-9]', '', 'g')) and length(regexp_replace(lower(string_split(name, '.')[-1]), '[^a-z0-9]', '', 'g')) > 2 leaked from n join t using (doc_id)")
def leakage_audit(spark, sf_dir):
    """Q12, F24."""
    d = b.table(spark, sf_dir, "documents")
    return evaluate.leaks(d.select(F.col("doc_id").alias("case_id"), F.col("text").alias("task")), d.select(F.col("doc_id").alias("case_id"), F.concat_ws(".", "source", "lang").alias("name")))


# --- usage ---------------------------------------------------------------------------------------------------------------

LOG = "lg as (select event_id, ts, event_type tool, user_id::varchar project, event_type <> 'error' ok, value ms, case when event_type = 'error' then 'no-context' when k < 10 then 'not-covered' else 'complete' end outcome, k, ret, greatest(k - ret, 0) saved from (select *, (props->>'$.k')::bigint k, round(value)::bigint ret from events))"
BY = "count(*) calls, count_if(not ok) failed, count_if(outcome = 'no-context') no_context, count_if(outcome = 'not-covered') not_covered, sum(ret)::bigint returned_tokens, sum(saved)::bigint saved_tokens, round(avg(ms) / 1000, 6) mean_seconds"


@query(f"with {LOG} select tool, {BY} from lg group by tool")
def usage_by_tool(spark, sf_dir):
    """A10, Q8."""
    return usage.by_group(b.usage_log(spark, sf_dir), "tool")


@query(f"with {LOG} select project, {BY} from lg group by project")
def usage_by_project(spark, sf_dir):
    return usage.by_group(b.usage_log(spark, sf_dir), "project")


@query("select event_id, event_type tool, strftime(ts, '%Y-%m-%dT%H:%M') called_at from events order by ts desc, event_id limit 8")
def recent_calls(spark, sf_dir):
    """W10, F27."""
    return usage.recent(b.usage_log(spark, sf_dir), [F.desc("time"), "event_id"]).select("event_id", "tool", F.date_format("time", "yyyy-MM-dd'T'HH:mm").alias("called_at"))


@query("select event_id, event_type tool, quantile_cont(value, 0.5) over w median, quantile_disc(value, 0.95) over w p95 from events window w as (partition by event_type order by ts, event_id rows between 49 preceding and current row)")
def rolling_latency_50(spark, sf_dir):
    """W7, T1."""
    return usage.rolling_latency(b.usage_log(spark, sf_dir), "tool", ["time", "event_id"], "ms").select("event_id", "tool", "median", "p95")


@query(f"with {LOG} select event_id, project, (sum(k) over w)::bigint total_candidate, (sum(ret) over w)::bigint total_returned, (sum(saved) over w)::bigint total_saved from lg window w as (partition by project order by ts, event_id)")
def running_savings(spark, sf_dir):
    """W8, T2."""
    return usage.running_savings(b.usage_log(spark, sf_dir), "project", ["time", "event_id"], "candidate_tokens", "returned_tokens").select("event_id", "project", "total_candidate", "total_returned", "total_saved")


@query("select conv_id session, count(*) turns, count_if(role = 'assistant') tool_uses, count_if(role = 'assistant' and starts_with(lower(text), 'a')) own_uses from conversations group by conv_id")
def transcript_sessions(spark, sf_dir):
    """A25, S19."""
    c = b.table(spark, sf_dir, "conversations")
    m = c.select(F.col("conv_id").alias("session"), F.when(F.col("role") == "assistant", "tool_use").otherwise("text").alias("block_type"), F.when(F.startswith(F.lower("text"), F.lit("a")), "mcp__x").otherwise("x").alias("block_name"))
    return usage.session_counts(m)


@query("select (event_id % 5)::bigint batch, count(*) n, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95 from events group by 1")
def batch_latency(spark, sf_dir):
    """A24."""
    return usage.percentiles(b.table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("batch"), "value"), ["batch"], "value")


# --- judging, blending and the rest --------------------------------------------------------------------------------------


@query("select source, doc_id, floor((row_number() over (partition by source order by doc_id) - 1) / 16)::int batch from documents")
def batch_assignment(spark, sf_dir):
    """X4."""
    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return b.table(spark, sf_dir, "documents").select("source", "doc_id", F.floor((r - 1) / 16).cast("int").alias("batch"))


@query("select doc_id, case when quality is null then 0.0 else quality::double end score, (quality is null)::int invalid from documents left join labels using (doc_id)")
def judge_join_default(spark, sf_dir):
    """J3, F19."""
    d = b.table(spark, sf_dir, "documents").select("doc_id").join(b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("q")), "doc_id", "left")
    return d.select("doc_id", scoring.valid_score(F.col("q")).alias("score"), F.col("q").isNull().cast("int").alias("invalid"))


@query(f"with {ITEM} select doc_id, case when quality is null then score else round(0.7 * quality + 0.3 * score, 9) end final from i where quality is null or quality >= 0.3")
def blend_floor(spark, sf_dir):
    """The floor is on the answer; rows without one keep their structural score and stay."""
    i = b.scored_items(spark, sf_dir).select(F.col("doc_id").alias("node_id"), F.col("score").alias("structural"), F.array().cast("array<string>").alias("sources"), F.col("quality").cast("double").alias("q"))
    kept = rank_pool(i.drop("q"), i.select("node_id", F.col("q").alias("answer")), 0.3)
    return kept.select(F.col("node_id").alias("doc_id"), F.when(F.col("answer").isNull(), F.col("final")).otherwise(F.round("final", 9)).alias("final"))


@query("with r as (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) - 1 r, count(*) over (partition by source) n from documents) select doc_id, round(0.8 - 0.4 * case when n <= 1 then 0 else r / (n - 1) end, 9) prior from r")
def lexical_prior(spark, sf_dir):
    """F16, W11."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")) - 1
    return d.select("doc_id", F.round(scoring.lexical_prior(r, F.count("*").over(Window.partitionBy("source"))), 9).alias("prior"))


@query("select event_id, round(case when event_type = 'view' then 1 else greatest(value / 400, case when event_id % 3 = 0 then 0.45 else 0 end) end * pow(0.8, event_id % 4), 9) priority from events")
def edge_priority(spark, sf_dir):
    """F17."""
    e = b.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(scoring.priority(F.col("value") / 400, F.col("event_id") % 4 + 1, F.col("event_id") % 3 == 0, F.col("event_type") == "view"), 9).alias("priority"))


@query("select doc_id, sha256(concat_ws(':', 'route', source, text)) digest from documents")
def request_digest(spark, sf_dir):
    """F22, T5."""
    return b.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws(":", F.lit("route"), "source", "text"), 256).alias("digest"))


@query(r"select page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) as directory, regexp_matches(url, '\.html?$', 'i') markup, case when length(t) > 48 then substring(t, 1, 48) || '…' else t end clipped from (select page_id, url, trim(regexp_replace(html, '\s+', ' ', 'g')) t from pages)")
def path_rules(spark, sf_dir):
    """F12, F21, S2."""
    p = b.table(spark, sf_dir, "pages")
    return p.select("page_id", text.directory_of(F.col("url")).alias("directory"), F.col("url").rlike(text.MARKUP_FILE).alias("markup"), text.clip(F.col("html")).alias("clipped"))


@query("select split_part(concat_ws('/', source, lang), '/', 1) section, count(*) n from documents group by 1")
def area_counts(spark, sf_dir):
    """A26."""
    return inventory.top_counts(b.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("file")))


@query("with s as (select source file, doc_id, row_number() over (partition by source order by doc_id, lang) r, lang from documents) select file, count(*) n_symbols, string_agg(doc_id || ': ' || lang || ' :: x', chr(10) order by r) filter (where r <= 80) summary from s group by file")
def file_summaries(spark, sf_dir):
    """J5 and the file nodes of the inventory."""
    d = b.table(spark, sf_dir, "documents")
    return inventory.file_summaries(d.select(F.col("source").alias("file"), F.col("doc_id").alias("start_line"), F.col("lang").alias("name"), F.lit("x").alias("signature")))


@query(f"with {EDGES}, {NODES}, l as (select e.src_id, e.dst_id, e.seq from e where kind = 'type'), o as (select src_id item_id, dst_id node_id, 1 hops, seq from l union all select a.src_id, z.dst_id, 2, z.seq from l a join l z on z.src_id = a.dst_id), m as (select item_id, node_id, min(row(hops, seq)) f from o where item_id like 'c:%' and node_id <> item_id group by all) select item_id, node_id, f[1]::int hops, (row_number() over (partition by item_id order by f, node_id))::int as rank from m qualify rank <= 6")
def supporting_context(spark, sf_dir):
    """J17 for every customer: its nation and region, all declarations in one file."""
    items = _ids(b.table(spark, sf_dir, "customer"), "c_custkey", "c")
    return graph.supporting_context(items, b.edges(spark, sf_dir), b.nodes(spark, sf_dir, one_file=True))


@query("with a as (select 's:' || l_suppkey src, 'o:' || l_orderkey lead_id, min(row(l_linenumber::bigint, 'p' || l_partkey)) f from lineitem group by all) select lead_id, src source_id, f[2] symbol, (row_number() over (partition by lead_id order by f, src))::int as rank from a qualify rank <= 6")
def argument_sources(spark, sf_dir):
    """J13 for every order: the suppliers that hand it a part."""
    i = b.table(spark, sf_dir, "lineitem")
    e = i.select(F.col("l_linenumber").cast("long").alias("seq"), F.concat(F.lit("s:"), "l_suppkey").alias("src_id"), F.concat(F.lit("o:"), "l_orderkey").alias("dst_id"), F.lit("argument").alias("kind"), F.concat(F.lit("p"), "l_partkey").alias("symbol"))
    return graph.argument_sources(_ids(b.table(spark, sf_dir, "orders"), "o_orderkey", "o"), e)


@query("select event_type, count(*) batches, sum(event_id % 16 + 1)::bigint candidates, sum(event_id % 3 + 1)::bigint requests, sum(event_id % 3)::bigint retries, count_if(event_id % 7 = 0) cache_hits, sum((props->>'$.k')::bigint)::bigint input_tokens, round(sum(value) , 9) cost from events group by event_type")
def judge_batch_totals(spark, sf_dir):
    """A9."""
    e = b.table(spark, sf_dir, "events")
    n = F.col("event_id")
    return usage.judge_batches(e.select("event_type", (n % 16 + 1).alias("candidates"), (n % 3 + 1).alias("attempts"), (n % 7 == 0).alias("cache_hit"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.col("value").alias("cost")), ["event_type"])


@query("select conv_id session, role arm, sum(length(text))::bigint tokens, count_if(turn % 2 = 0) searches, count(distinct turn % 5) files, bool_or(turn > 3) correct from conversations group by conv_id, role")
def agent_session_metrics(spark, sf_dir):
    """A27, Q14."""
    c = b.table(spark, sf_dir, "conversations")
    return usage.agent_sessions(c.select(F.col("conv_id").alias("session"), F.col("role").alias("arm"), F.when(F.col("turn") % 2 == 0, "search").otherwise("edit").alias("kind"), F.length("text").cast("long").alias("tokens"), (F.col("turn") % 5).alias("file"), (F.col("turn") > 3).alias("correct")))
