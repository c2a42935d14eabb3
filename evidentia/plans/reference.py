"""Queries over the retrieval and metadata operators, each with the SQL that checks it.

Names begin with the operator they show. Queries without SQL are those whose result SQL cannot
express; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import metadata as M
from evidentia.functions import replies as R
from evidentia.functions import text as T
from evidentia.functions import vectors as V
from evidentia.functions.doi import canonical_doi
from evidentia.operators import aggregates, chunking, filters, geometry, joins, merge, retrieval
from evidentia.plans import answering, models
from evidentia.session import table, widen
from evidentia.sources import files, providers, trials

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _details(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_details")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "parsed_texts").select(F.col("text_id").alias("dockey"), F.posexplode(F.split("content", "\f")).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def _contexts(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where("text <> ''").select(F.col("doc_id").alias("ctx_id"), F.coalesce("dockey", F.lit("none")).alias("dockey"), F.coalesce("doc_kind", F.lit("none")).alias("question"), F.col("source").alias("session"), F.concat(F.lit("chunk "), F.col("doc_id").cast("string")).alias("name"), F.pmod("doc_id", F.lit(11)).cast("int").alias("score"), F.col("text").alias("context"))


_CONTEXTS = "(select doc_id ctx_id, coalesce(dockey,'none') dockey, coalesce(doc_kind,'none') question, source as session, 'chunk '||doc_id as name, (doc_id % 11)::int score, text as context from documents where text <> '')"
_PAGES = "(select text_id dockey, unnest(string_split(content, chr(12))) as text, generate_subscripts(string_split(content, chr(12)),1) page_no from parsed_texts)"
_CANON = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(replace(replace(doi,'%2f','/'),'%2F','/'),'\s+','','g')),'^(https?://)?([a-z0-9-]+\.)*doi\.org/',''),'^(info:|urn:)?doi[:/]?',''),'^x^',''),'')"


# Scans and sources


@query("select doc_id, generate_subscripts(string_split(text, chr(10)),1)::int line_no, length(unnest(string_split(text, chr(10))))::int n_chars from documents where text is not null")
def src2_lines(s, d):
    lines = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), F.length("line").alias("n_chars"))


@query(r"select doc_id, length(trim(regexp_replace(regexp_replace('<p>'||coalesce(source,'')||'</p><b>'||doc_id||'</b>','<[^>]*>',' ','g'),'\s+',' ','g')))::int n_chars from documents")
def src3_html(s, d):
    html = F.concat(F.lit("<p>"), F.coalesce("source", F.lit("")), F.lit("</p><b>"), F.col("doc_id").cast("string"), F.lit("</b>"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
    return _docs(s, d).select("doc_id", F.length(plain).alias("n_chars"))


@query("select doc_id, case when substr(text,1,4)='%PDF' then 'pdf' when substr(text,1,4) in ('<htm','<!DO','<xsl') then 'html' else 'text' end kind from documents")
def src11_sniff(s, d):
    return _docs(s, d).select("doc_id", files.sniffed("text").alias("kind"))


@query(f"select dockey, page_no::int page_no, length(text)::int n_chars from {_PAGES} where page_no between 2 and 3")
def src13_page_range(s, d):
    return files.page_range(_pages(s, d), (2, 3)).select("dockey", "page_no", F.length("text").alias("n_chars"))


@query("select record_no, arg_max(title, row_id) title, max(row_id) row_id from retractions group by record_no")
def src14_last_row(s, d):
    return table(s, d, "retractions").groupBy("record_no").agg(F.max_by("title", "row_id").alias("title"), F.max("row_id").alias("row_id"))


@query("select distinct doi from (select retraction_doi doi from retractions where retraction_nature='Retraction' union all select original_paper_doi from retractions where retraction_nature='Retraction') where trim(doi) <> ''")
def src15_retraction_dois(s, d):
    return joins.retraction_dois(table(s, d, "retractions"))


@query("select clean_name, arg_max(quality, line_no)::int quality from journal_quality group by clean_name")
def src16_journal_quality(s, d):
    return table(s, d, "journal_quality").groupBy("clean_name").agg(F.max_by("quality", "line_no").alias("quality"))


@query("""select record_id, lower(case when starts_with(doi,'https://doi.org/') then replace(doi,'https://doi.org/','') when starts_with(doi,'http://dx.doi.org/') then replace(doi,'http://dx.doi.org/','') else nullif(doi,'') end) doi,
title, pub_year::int as year, journal, volume, issue, pages, citation_count from doc_details""")
def src17_crossref(s, d):
    row = F.struct(
        F.col("doi").alias("DOI"), F.array("title").alias("title"), F.struct(F.array(F.array("pub_year")).alias("date-parts")).alias("published"), F.array("journal").alias("container-title"),
        "volume", "issue", F.col("pages").alias("page"), F.col("citation_count").alias("is-referenced-by-count"),
    )
    got = providers.crossref(_details(s, d).select("record_id", F.to_json(row).alias("json")))
    return got.select("record_id", "doi", "title", "year", "journal", "volume", "issue", "pages", "citation_count")


@query(r"""select paper_id, title, coalesce(len(authors),0)::int n_authors, pub_year::int as year, citation_count,
case when regexp_matches(publication_date,'^\d{4}-\d{2}-\d{2}$') then strftime(strptime(publication_date,'%Y-%m-%d'),'%Y-%m-%d') end published from s2_papers""")
def src18_scholar(s, d):
    row = F.struct("title", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), F.col("pub_year").alias("year"), F.col("publication_date").alias("publicationDate"), F.col("citation_count").alias("citationCount"))
    got = providers.scholar(table(s, d, "s2_papers").select("paper_id", F.to_json(row).alias("json")))
    return got.select("paper_id", "title", F.greatest(F.coalesce(F.size("authors"), F.lit(0)), F.lit(0)).alias("n_authors"), "year", "citation_count", F.date_format("publication_date", "yyyy-MM-dd").alias("published"))


@query("select record_id, title, journal, nullif(split_part(coalesce(pages,''),'-',2),'') pages, citation_count, license from doc_details")
def src20_openalex(s, d):
    last = F.nullif(F.split_part(F.coalesce("pages", F.lit("")), F.lit("-"), F.lit(2)), F.lit(""))
    row = F.struct("title", F.struct(F.struct(F.col("journal").alias("display_name")).alias("source")).alias("primary_location"), F.struct(last.alias("last_page")).alias("biblio"), F.col("citation_count").alias("cited_by_count"), F.struct("license").alias("best_oa_location"))
    return providers.openalex(_details(s, d).select("record_id", F.to_json(row).alias("json"))).select("record_id", "title", "journal", "pages", "citation_count", "license")


@query("select record_id, title, publisher, pub_year::int as year, pdf_url from doc_details")
def src21_unpaywall(s, d):
    row = F.struct("title", "publisher", F.col("pub_year").alias("year"), F.struct(F.col("pdf_url").alias("url_for_pdf")).alias("best_oa_location"))
    return providers.unpaywall(_details(s, d).select("record_id", F.to_json(row).alias("json"))).select("record_id", "title", "publisher", "year", "pdf_url")


@query("select doc_id, source from documents where doc_kind='trial' order by doc_id limit 10 offset 5")
def src22_trials(s, d):
    return trials.search(_docs(s, d).where("doc_kind = 'trial'").withColumn("rank", F.col("doc_id")), 10, 5).select("doc_id", "source")


@query("select distinct pdf_url as pdf from doc_details where pdf_url is not null")
def src23_library(s, d):
    return trials.read_library(_details(s, d).select(F.col("pdf_url").alias("pdf")))


@query("select dockey, count(*) n from documents where dockey is not null group by dockey")
def src25_store_docs(s, d):
    return _docs(s, d).where("dockey is not null").groupBy("dockey").agg(F.count("*").alias("n"))


# Sinks


@query("""with r as (select lower(clean_name) clean_name, case when quality between 0 and 9 and quality <> 3 then quality else -1 end quality from journal_quality),
b as (select distinct clean_name, quality from journal_quality where quality = 0),
k as (select r.* from r left join b on r.clean_name=b.clean_name and r.quality=b.quality where b.clean_name is null)
select distinct clean_name, quality::int quality from (select * from k where clean_name not in (select clean_name from journal_quality where line_no % 10 = 1) union all select clean_name, 2 from journal_quality where line_no % 10 = 1)""")
def snk11_refresh_quality(s, d):
    q = table(s, d, "journal_quality")
    ranking = q.select(F.col("clean_name").alias("name"), F.when(F.col("quality") == 3, "4").otherwise(F.col("quality").cast("string")).alias("level"))
    return aggregates.refreshed_quality(ranking, q.where("line_no % 10 = 1").select("clean_name", F.lit(2).alias("quality")), q.where("quality = 0"))


# Filters


@query("select record_id from doc_details where publisher is not distinct from 'Northmere Open' and license is distinct from 'public-domain' and (bibtex_type is null or bibtex_type is not distinct from 'article')")
def flt1_criteria(s, d):
    return filters.filter_documents(_details(s, d), [{"publisher": "Northmere Open", "!license": "public-domain"}, {"?bibtex_type": "article", "?no_such_field": 1}]).select("record_id")


_ENTROPY = "(with c as (select doc_id, ch, count(*) c from (select doc_id, unnest(string_split(replace(text,' ',''),'')) ch from documents where text is not null) where ch<>'' group by all) select doc_id, log2(sum(c)) - sum(c*log2(c))/sum(c) e from c group by doc_id)"


@query(f"select doc_id, round(e,5) entropy, (e > 2.5 and e < 8.0) is_text from {_ENTROPY}")
def flt2_entropy(s, d):
    return widen(_docs(s, d).select("doc_id", "text")).select("doc_id", filters.entropy("text").alias("e")).where("e is not null").select("doc_id", F.round("e", 5).alias("entropy"), ((F.col("e") > 2.5) & (F.col("e") < 8)).alias("is_text"))


@query("""with c as (select doc_id dockey, substr(text,1,400) one, substr(text,1,800) two, substr(text,1,2000) five from documents where length(text)>0),
e as (with k as (select dockey, ch, count(*) c from (select dockey, unnest(string_split(replace(five,' ',''),'')) ch from c) where ch<>'' group by all) select dockey, log2(sum(c)) - sum(c*log2(c))/sum(c) e from k group by dockey)
select c.dockey from c join e using (dockey) where length(one)>=10 and length(replace(two,chr(10),''))>=20 and e>2.5 and e<8""")
def flt3_valid_documents(s, d):
    chunks = chunking.text_chunks(_docs(s, d).select(F.col("doc_id").alias("dockey"), "text"), 400, 0).withColumn("is_image", F.lit(False))
    return filters.valid_documents(chunks)


@query(f"select dockey, page_no::int page_no, length(text) <= 2000 fits from {_PAGES}")
def flt4_page_limit(s, d):
    good, bad = filters.within_page_limit(_pages(s, d), 2000)
    return good.select("dockey", "page_no", F.lit(True).alias("fits")).unionByName(bad.select("dockey", "page_no", F.lit(False).alias("fits")))


@query(f"select ctx_id, score from {_CONTEXTS} where score>0 and ctx_id % 3 <> 0")
def flt5_new_evidence(s, d):
    c = _contexts(s, d)
    return filters.new_evidence(c, c.where("ctx_id % 3 = 0")).select("ctx_id", "score")


@query(f"select ctx_id from {_CONTEXTS} where score >= 8")
def flt6_cutoff(s, d):
    return _contexts(s, d).where(F.col("score") >= 8).select("ctx_id")


@query(f"select ctx_id from {_CONTEXTS} where score > 5")
def flt7_relevant(s, d):
    return filters.scored(_contexts(s, d), 5).select("ctx_id")


@query(f"select distinct dockey from {_CONTEXTS} where score >= 3")
def flt8_documents_of(s, d):
    return filters.documents_of(_contexts(s, d), 3)


@query("select doc_id, lang, source, n_chars, doc_kind, dockey, fetched_at from documents")
def flt11_display(s, d):
    return filters.for_display(_docs(s, d))


@query("select record_id, len(list_filter(list_concat(authors,['et al','','Et Al.']), lambda a: a is not null and a<>'' and lower(a) not in ('et al','et al.')))::int n from doc_details where authors is not null")
def flt12_authors(s, d):
    padded = F.concat("authors", F.array(F.lit("et al"), F.lit(""), F.lit("Et Al.")))
    return _details(s, d).where("authors is not null").select("record_id", F.size(M.valid_authors(padded)).alias("n"))


@query("select record_id, (title is null or journal is null or pub_year is null or doi is null) needed from doc_details")
def flt13_hydration(s, d):
    return _details(s, d).select("record_id", M.hydration_needed(["title", "journal", "pub_year", "doi"]).alias("needed"))


# Joins


@query("select d.doc_id, m.record_id, m.docname from documents d join doc_details m using (dockey)")
def jn1_chunk_document(s, d):
    return _docs(s, d).select("doc_id", "dockey").join(_details(s, d).select("dockey", "record_id", "docname"), "dockey").select("doc_id", "record_id", "docname")


@query("""with f as (select doc_id, coalesce(dockey,'') as path, 'n'||doc_id as name from documents), m as (select file_location, arg_max(title,pos) title from (select dockey file_location, title, record_id pos from doc_details union all select 'n'||record_id, title, record_id from doc_details where record_id < 2000) group by 1)
select f.doc_id, case when a.file_location is not null then a.title else b.title end title from f left join m a on f.path=a.file_location left join m b on f.name=b.file_location""")
def jn2_manifest(s, d):
    details = _details(s, d)
    manifest = details.select(F.col("dockey").alias("file_location"), "title", F.col("record_id").alias("pos")).unionByName(details.where("record_id < 2000").select(F.concat(F.lit("n"), F.col("record_id").cast("string")).alias("file_location"), "title", F.col("record_id").alias("pos")))
    paths = _docs(s, d).select("doc_id", F.coalesce("dockey", F.lit("")).alias("path"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"))
    return joins.with_manifest(paths, manifest).select("doc_id", "title")


@query("""with q as (select clean_name, arg_max(quality,line_no) q from journal_quality group by 1), v as (select distinct journal, unnest([lower(replace(journal,'amp;','')), 'the '||lower(replace(journal,'amp;','')), replace(lower(replace(journal,'amp;','')),'&','and')]) clean_name from doc_details where journal is not null),
b as (select journal, max(q) q from v join q using (clean_name) group by 1) select record_id, coalesce(q,-1)::int quality from doc_details left join b using (journal)""")
def jn3_journal_quality(s, d):
    return joins.journal_quality(_details(s, d).select("record_id", "journal"), table(s, d, "journal_quality")).select("record_id", "quality")


_NORMAL = "lower(nullif(case when starts_with({0},'https://doi.org/') then replace({0},'https://doi.org/','') when starts_with({0},'http://dx.doi.org/') then replace({0},'http://dx.doi.org/','') else {0} end,''))"


@query(f"""with r as (select distinct {_NORMAL.format('trim(doi)')} k from (select retraction_doi doi from retractions where retraction_nature='Retraction' union all select original_paper_doi from retractions where retraction_nature='Retraction') where trim(doi)<>'')
select record_id, r.k is not null retracted from doc_details left join r on {_NORMAL.format('trim(doi)')} = r.k""")
def jn4_retracted(s, d):
    return joins.flag_retracted(_details(s, d).select("record_id", "doi"), table(s, d, "retractions")).select("record_id", "retracted")


@query("select doc_id from documents where coalesce(dockey,'') not in (select dockey from doc_details where record_id % 2 = 0) and dockey is not null")
def jn7_without_deleted(s, d):
    return _docs(s, d).where("dockey is not null").join(_details(s, d).where("record_id % 2 = 0").select("dockey"), "dockey", "left_anti").select("doc_id")


@query("select doc_id from documents where text is not null and md5(text) not in (select md5(text) from documents where text is not null and doc_id % 2 = 1)")
def jn8_new_chunks(s, d):
    c = _docs(s, d).where("text is not null").select("doc_id", F.md5("text").alias("h"))
    return c.join(c.where("doc_id % 2 = 1").select("h"), "h", "left_anti").select("doc_id")


@query(f"""with p as (select dockey, page_no, sum(length(text)) over (partition by dockey order by page_no) upto, length(text) n from {_PAGES}),
c as (select text_id dockey, i chunk_ix, i*2000 as b, least(i*2000+2500, length(content)) e from (select text_id, content, unnest(range(0, greatest(0, ceil((length(content)-2500)/2000.0))::bigint+1)) i from parsed_texts))
select c.dockey, c.chunk_ix::int chunk_ix, p.page_no::int page_no from c join p on c.dockey=p.dockey and c.b < p.upto and p.upto-p.n < c.e and p.n>0""")
def jn10_chunk_pages(s, d):
    spans = chunking.page_spans(_pages(s, d)).select("dockey", "page_no", "before", "upto")
    n = F.greatest(F.lit(0), F.ceil((F.length("content") - 2500) / 2000)).cast("int")
    chunks = table(s, d, "parsed_texts").select(F.col("text_id").alias("dockey"), F.length("content").alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("chunk_ix"))
    chunks = chunks.select("dockey", "chunk_ix", (F.col("chunk_ix") * 2000).alias("begin"), F.least(F.col("chunk_ix") * 2000 + 2500, "n").alias("end"))
    return joins.chunk_pages(chunks, spans)


@query(f"select a.dockey, a.page_no::int page_no, (sum(length(b.text)) + 2*(count(*)-1))::bigint n_chars from {_PAGES} a join {_PAGES} b on a.dockey=b.dockey and abs(a.page_no-b.page_no)<=1 group by all")
def jn11_page_neighbours(s, d):
    return joins.page_neighbours(_pages(s, d), 1).select("dockey", "page_no", F.length("context").cast("bigint").alias("n_chars"))


def _boxes(s: SparkSession, d: str, status: str) -> DataFrame:
    x, y = F.pmod("l_partkey", F.lit(7)) / 10, F.pmod("l_suppkey", F.lit(5)) / 10
    w = 0.2 + F.col("l_linenumber") / 20
    return table(s, d, "lineitem").where(F.col("l_linestatus") == status).select(F.floor(F.col("l_orderkey") / 4).alias("page"), F.col("l_returnflag").alias("class"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + w).alias("ymax"))


_BOX = "(select l_orderkey // 4 page, l_returnflag class, l_orderkey*10+l_linenumber id, (l_partkey%7)/10.0::double xmin, (l_suppkey%5)/10.0::double ymin, (l_partkey%7)/10.0::double+(0.2::double+l_linenumber/20.0::double) xmax, (l_suppkey%5)/10.0::double+(0.2::double+l_linenumber/20.0::double) ymax from lineitem where l_linestatus='{}')"


@query(f"""with a as {_BOX.format('O')}, b as {_BOX.format('F')}, m as (select a.page, a.class, a.id left_id, b.id right_id, greatest(0,least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin))*greatest(0,least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin)) i,
(a.xmax-a.xmin)*(a.ymax-a.ymin) s, (b.xmax-b.xmin)*(b.ymax-b.ymin) t from a join b using (page, class)), k as (select *, round(i/(s+t-i),9) iou from m), best as (select * from (select *, row_number() over (partition by page,class,left_id order by round(iou,9) desc, right_id) r from k where iou>=0.3) where r=1)
select page, class, left_id, right_id, round(iou,5) iou from best union all select page,class,id,null,null from a where (page,class,id) not in (select (page,class,left_id) from best) union all select page,class,null,id,null from b where (page,class,id) not in (select (page,class,right_id) from best)""")
def jn12_match_boxes(s, d):
    return geometry.match_boxes(_boxes(s, d, "O"), _boxes(s, d, "F"), ["page", "class"], 0.3).withColumn("iou", F.round("iou", 5))


@query()
def jn13_cluster_boxes(s, d):
    return geometry.cluster_boxes(_boxes(s, d, "O"), "page", 0.05)


@query()
def jn14_best_title(s, d):
    a = table(s, d, "s2_papers").select(F.col("paper_id").alias("asked_id"), F.col("title").alias("asked_title"))
    return providers.best_by_title(a, _details(s, d).select("record_id", "title")).withColumn("similarity", F.round("similarity", 6))


@query()
def jn15_authors_agree(s, d):
    a = table(s, d, "s2_papers").select("paper_id", F.lower("title").alias("t"), F.col("authors").alias("a"))
    b = _details(s, d).select("record_id", F.lower("title").alias("t"), F.col("authors").alias("b"))
    return a.join(b, "t").select("paper_id", "record_id", joins.authors_agree("a", "b").alias("agree"))


# Aggregates


@query()
def agg1_merge(s, d):
    r = _details(s, d).select(canonical_doi("doi").alias("work"), "record_id", F.array("client_source").alias("client_source"), "title", "authors", F.col("pub_year").alias("year"), "publication_date", "journal", "publisher", "citation_count", "doi", "license", "bibtex").where("work is not null")
    return merge.merge_records(r, "work", ["record_id"])


@query(f"select {_CANON} work, max(citation_count) citation_count, max(pub_year)::int as year, count(*) n from doc_details where {_CANON} is not null group by 1")
def agg2_fan_in(s, d):
    r = _details(s, d).select(canonical_doi("doi").alias("work"), F.col("pub_year").alias("year"), "citation_count", "client_source", F.col("record_id").alias("place_id"), F.array("client_source").alias("sources")).where("work is not null")
    tiers = merge.fan_in([[r.where("client_source = 'crossref'"), r.where("client_source = 'openalex'")], [r.where("client_source not in ('crossref', 'openalex') or client_source is null")]])
    out = merge.merge_records(tiers.drop("client_source").withColumnRenamed("sources", "client_source"), "work", ["tier", "place", "place_id"])
    return out.select("work", "citation_count", "year", F.size("client_source").cast("bigint").alias("n"))


@query("select source as session, coalesce(lang,'none') model, sum(n_chars)::bigint prompt, sum(length(text))::bigint completion, round(sum(n_chars*0.001),3) as cost from documents group by all")
def agg3_token_usage(s, d):
    calls = _docs(s, d).select(F.col("source").alias("session"), F.coalesce("lang", F.lit("none")).alias("model"), F.col("n_chars").alias("prompt"), F.length("text").cast("bigint").alias("completion"), (F.col("n_chars") * 0.001).alias("cost"))
    return aggregates.token_usage(calls).withColumn("cost", F.round("cost", 3))


@query(f"select session, count(distinct dockey) papers, count(distinct case when score>0 then dockey end) relevant, count(case when score>0 then 1 end) evidence from {_CONTEXTS} group by session")
def agg4_status(s, d):
    return aggregates.status(_contexts(s, d))


@query(f"select question, min(ctx_id) as first, md5(string_agg(context, chr(10)||chr(10) order by ctx_id)) section from {_CONTEXTS} group by question")
def agg5_sections(s, d):
    return aggregates.sections(_contexts(s, d), "question", "ctx_id", "context").withColumn("section", F.md5("section"))


@query(f"select dockey, md5(string_agg(context,'' order by ctx_id)) body from {_CONTEXTS} group by dockey")
def agg6_joined_text(s, d):
    return aggregates.joined_text(_contexts(s, d), "dockey", "ctx_id", "context").withColumn("body", F.md5("body"))


@query(f"select dockey, md5(string_agg(text, chr(10)||chr(10) order by page_no)) body from {_PAGES} group by dockey")
def agg7_reduced_pages(s, d):
    return aggregates.joined_text(_pages(s, d), "dockey", "page_no", "text", "\n\n").withColumn("body", F.md5("body"))


@query("select event_type as name, round(min(value),6) low, round(avg(value),6) mean, round(max(value),6) max, round(sum(value),4) total from events group by 1")
def agg9_timings(s, d):
    t = aggregates.timings(table(s, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds")))
    return t.select("name", F.round("low", 6).alias("low"), F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"), F.round("total", 4).alias("total"))


_TOKENS = r"(select doc_id, unnest(string_split_regex(lower(text),'[^\p{L}\p{N}]+')) term from documents where text is not null)"


@query(f"select term, count(distinct doc_id) df, count(*)::bigint tf from {_TOKENS} where term<>'' and strlen(term)<=40 group by term")
def agg10_term_statistics(s, d):
    return retrieval.term_statistics(_docs(s, d).where("text is not null"), "doc_id", "text")


@query(f"select term, doc_id, count(*)::bigint tf from {_TOKENS} where term<>'' and strlen(term)<=40 group by all")
def agg10_postings(s, d):
    return retrieval.postings(_docs(s, d).where("text is not null"), "doc_id", "text")


@query("select source, count(*) total, sum((dockey is not null)::int)::bigint enriched, sum((n_chars is null)::int)::bigint filtered from documents group by source")
def agg11_media_counts(s, d):
    one = lambda c: F.sum(c.cast("int")).alias
    return _docs(s, d).groupBy("source").agg(F.count("*").alias("total"), one(F.col("dockey").isNotNull())("enriched"), one(F.col("n_chars").isNull())("filtered"))


# Windows


def _similar(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return retrieval.similarities(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), keep=10, part="label")


_SIM = "(select q.vec_id query_id, e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) sim from embeddings e, embeddings q where q.vec_id % 100 = 0)"


@query(f"with a as (select *, row_number() over (partition by query_id,label order by round(sim,9) desc, vec_id) w from {_SIM}), b as (select *, row_number() over (partition by query_id order by w,label) as rank from a where w<=10) select query_id, vec_id, rank::int as rank from b where rank<=10")
def win1_interleaved(s, d):
    return retrieval.partitioned_top_k(_similar(s, d).select("query_id", "vec_id", "label", "similarity"), "label", 10).select("query_id", "vec_id", "rank")


@query(f"select dockey, page_no::int page_no, (sum(length(text)) over (partition by dockey order by page_no))::bigint upto from {_PAGES}")
def win2_cumulative(s, d):
    return chunking.page_spans(_pages(s, d)).select("dockey", "page_no", "upto")


@query("select record_id, case when k=1 then docname else docname||chr((95+k)::int) end unique_docname from (select record_id, docname, row_number() over (partition by docname order by record_id) k from doc_details)")
def win3_docnames(s, d):
    return filters.unique_docnames(_details(s, d).select("record_id", "docname"), "record_id").select("record_id", "unique_docname")


@query("select doc_id, text from (select doc_id, md5(text) as text, row_number() over (partition by text order by doc_id) k from documents where text is not null) where k=1")
def win4_first_occurrence(s, d):
    k = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    return _docs(s, d).where("text is not null").select("doc_id", F.md5("text").alias("h")).withColumn("k", k).where("k = 1").select("doc_id", F.col("h").alias("text"))


@query("select record_id, generate_subscripts(authors,1)::int n, unnest(authors) author from (select record_id, list_filter(authors, lambda a, i: list_position(authors, a) = i) authors from doc_details where authors is not null)")
def win5_numbering(s, d):
    return _details(s, d).select("record_id", F.posexplode(F.array_distinct("authors")).alias("i", "author")).select("record_id", (F.col("i") + 1).alias("n"), "author")


# Ranking


@query(f"select query_id, vec_id, round(sim,5) similarity, rank::int as rank from (select *, row_number() over (partition by query_id order by round(sim,9) desc, vec_id) as rank from {_SIM}) where rank<=10")
def top1_cosine(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.cosine_top_k(e, q, 10).withColumn("similarity", F.round("similarity", 5))


@query()
def top2_diverse(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    fetched = retrieval.cosine_top_k(e, q, 20).join(e.select("vec_id", "embedding"), "vec_id")
    return retrieval.diverse(fetched, 10, 0.5)


@query(f"select query_id, vec_id, rank::int as rank from (select *, row_number() over (partition by query_id order by round(sim,9) desc, vec_id) as rank from {_SIM} where label <> 3) where rank<=5")
def top3_retrieve(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.retrieve(e, e.where("label = 3"), q, 5).select("query_id", "vec_id", "rank")


@query(f"select ctx_id, score from {_CONTEXTS} where score>=1 order by score desc, name, ctx_id limit 5")
def top5_best_evidence(s, d):
    return retrieval.best_evidence(_contexts(s, d), 5).select("ctx_id", "score")


@query(f"select ctx_id from {_CONTEXTS} where question='abstract' or question='none' order by score desc, ctx_id limit 7")
def top6_current_evidence(s, d):
    return _contexts(s, d).where("question = 'abstract' or question = 'none'").orderBy(F.desc("score"), "ctx_id").limit(7).select("ctx_id")


_BM25 = f"""with t as (select * from {_TOKENS} where term<>'' and strlen(term)<=40), n as (select count(*) n from documents where text is not null), dl as (select doc_id, count(*) dl from t group by 1), av as (select sum(dl)::double/(select n from n) a from dl),
q as (select distinct item_id, term from (select item_id, unnest(string_split_regex(lower(question),'[^\\p{{L}}\\p{{N}}]+')) term from eval_items) where term<>'' and strlen(term)<=40), tf as (select term, doc_id, count(*) tf from t where term in (select term from q) group by all),
df as (select term, count(*) df from tf group by 1), w as (select tf.term, tf.doc_id, ln(1+((select n from n)-df+0.5)/(df+0.5)) * tf*2.2/(tf+1.2*(0.25+0.75*dl/(select a from av))) w from tf join df using (term) join dl using (doc_id)),
sc as (select item_id, doc_id, sum(w) score from w join q using (term) group by all), r as (select *, row_number() over (partition by item_id order by round(score,9) desc, doc_id) as rank from sc)"""


@query(_BM25 + " select item_id, doc_id, rank::int as rank, round(score,4) score from r where rank<=10")
def top7_bm25(s, d):
    got = retrieval.bm25(_docs(s, d), table(s, d, "eval_items"), 10, query_key="item_id", query="question")
    return got.withColumn("score", F.round("score", 4))


@query("select item_id, regexp_replace(question||' [x]: (y)~^>', '[\\[\\]*:(){}~^><+\"\\\\]', '', 'g') cleaned from eval_items")
def top8_clean_query(s, d):
    return table(s, d, "eval_items").select("item_id", T.search_query(F.concat("question", F.lit(" [x]: (y)~^>"))).alias("cleaned"))


@query(_BM25 + " select item_id, doc_id, rank::int as rank from r where rank>8 and rank<=16")
def top9_next_page(s, d):
    return retrieval.bm25(_docs(s, d), table(s, d, "eval_items"), 8, query_key="item_id", query="question", offset=8).select("item_id", "doc_id", "rank")


@query("select array_to_string(list_sort(list_distinct(flatten(list(parsing_libraries)))),'|') as libraries from parsed_texts where parsing_libraries is not null")
def top10_sorted_union(s, d):
    return aggregates.vocabulary_of(table(s, d, "parsed_texts"), "parsing_libraries").select(F.array_join("all", "|").alias("libraries"))


# Text functions


@query("select doc_id, length(replace(coalesce(text,''), chr(0), chr(65533)))::int n from documents")
def str1_unicode(s, d):
    return _docs(s, d).select("doc_id", F.length(T.clean_unicode(F.coalesce("text", F.lit("")))).alias("n"))


@query(r"select doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])results($|[^\p{L}\p{N}_])') found from documents where text is not null")
def str2_name_in_text(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", T.name_in_text(F.lit(" results "), "text").alias("found"))


@query(r"""with m as (select record_id, list_distinct(list_filter(string_split_regex(lower(title),'[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x<>'')) x, list_distinct(list_filter(string_split_regex(lower(journal),'[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x<>'')) y, title, journal from doc_details)
select record_id, case when coalesce(title,'')='' or coalesce(journal,'')='' or len(list_distinct(list_concat(x,y)))=0 then 0.0 else round(len(list_intersect(x,y))::double/len(list_distinct(list_concat(x,y))),6) end similarity from m""")
def str3_similarity(s, d):
    return _details(s, d).select("record_id", F.round(T.similarity("title", "journal"), 6).alias("similarity"))


@query(r"select record_id, regexp_replace(citation, '[\w-]+\s+et\s+al\.\s+\(\d{4}\)|\([^)A-Za-z]*[A-Za-z][^)]*\d{4}[^)]*\)', '', 'g') stripped from doc_details where citation is not null")
def str4_strip_citations(s, d):
    return _details(s, d).where("citation is not null").select("record_id", T.strip_citations("citation").alias("stripped"))


@query(r"""select doc_id, (case when n>10 then n//10 else n end)::int score from (select doc_id, coalesce(nullif(regexp_extract(t,'[sS]core[:is\s]+([0-9]+)',1),''), nullif(regexp_extract(t,'\(([0-9])\w*/',1),''), nullif(regexp_extract(t,'([0-9]+)\w*/',1),''))::bigint n from (select doc_id, case doc_id%3 when 0 then 'good. Score: '||(doc_id%101) when 1 then 'fine ('||(doc_id%10)||'/10)' else (doc_id%100)||'/100 so' end t from documents))""")
def str5_score(s, d):
    k = F.col("doc_id")
    t = F.when(k % 3 == 0, F.concat(F.lit("good. Score: "), (k % 101).cast("string"))).when(k % 3 == 1, F.concat(F.lit("fine ("), (k % 10).cast("string"), F.lit("/10)"))).otherwise(F.concat((k % 100).cast("string"), F.lit("/100 so")))
    return _docs(s, d).select("doc_id", R.score_of(t).alias("score"))


@query("""with c as (select doc_id, unnest(string_split(regexp_replace(text,'[^()]','','g'),'')) ch, generate_subscripts(string_split(regexp_replace(text,'[^()]','','g'),''),1) i from documents where text is not null),
s as (select doc_id, ch, sum(case ch when '(' then 1 else -1 end) over (partition by doc_id order by i) b from c where ch<>''),
m as (select doc_id, (count(case when ch=')' then 1 end) + least(0, min(b)))::int n from s group by 1) select doc_id, coalesce(n,0)::int n from documents left join m using (doc_id) where text is not null""")
def str6_parentheses(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.size(T.nested_parentheses("text")).alias("n"))


@query("select doc_id, array_to_string(list_distinct_ordered,' ') ids from (select doc_id, ['pqac-'||substr(md5(source),1,8), 'pqac-'||substr(md5(doc_id::varchar),1,8)] list_distinct_ordered from documents where source is not null)")
def str7_citation_ids(s, d):
    a, b = F.concat(F.lit("pqac-"), F.substring(F.md5("source"), 1, 8)), F.concat(F.lit("pqac-"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8))
    t = F.concat(F.lit("As said ("), a, F.lit(", "), b, F.lit(") and ("), a, F.lit(") pqac-short."))
    return _docs(s, d).where("source is not null").select("doc_id", F.array_join(T.citation_ids(t), " ").alias("ids"))


@query(r"select record_id, case when regexp_extract(doi,'(?i)(10.\d{4,9}/[-._;()/:A-Z0-9]+)',1)='' then '' else 'https://doi.org/'||regexp_extract(doi,'(?i)(10.\d{4,9}/[-._;()/:A-Z0-9]+)',1) end link from doc_details where doi is not null")
def str8_doi(s, d):
    return _details(s, d).where("doi is not null").select("record_id", T.doi_link("doi").alias("link"))


@query("select record_id, translate(docname, 'aeiou', '') bare from doc_details where docname is not null")
def str9_without(s, d):
    return _details(s, d).where("docname is not null").select("record_id", T.without("docname", list("aeiou")).alias("bare"))


@query()
def str10_accents(s, d):
    return _details(s, d).where("title is not null").select("record_id", T.strip_accents("title").alias("plain"))


@query("""select item_id, case item_id%4 when 0 then topic||'s quoted parts end' when 1 then ' '||topic||' of '||item_id when 2 then topic||' '||topic||'s' else 's '||topic end cleaned from eval_items where not contains(topic,chr(39))""")
def str11_possessives(s, d):
    k, t = F.col("item_id") % 4, F.col("topic")
    said = F.when(k == 0, F.concat(t, F.lit("'s 'quoted' parts' end"))).when(k == 1, F.concat(F.lit(" '"), t, F.lit("' of '"), F.col("item_id").cast("string"))).when(k == 2, F.concat(t, F.lit(" ' "), t, F.lit("s'"))).otherwise(F.concat(F.lit("s' "), t))
    return table(s, d, "eval_items").where("not contains(topic, chr(39))").select("item_id", T.clean_possessives(said).alias("cleaned"))


@query("select record_id, coalesce(nullif(regexp_extract(citation,'([A-Z][a-z]+)',1),''), nullif(regexp_extract(citation,'([A-Z0-9]{2,})',1),''), 'Doc'||substr(md5(citation),1,8)) || regexp_extract(citation,'([0-9]{4})',1) docname from doc_details where citation is not null")
def str12_docname(s, d):
    return _details(s, d).where("citation is not null").select("record_id", T.docname("citation").alias("docname"))


@query()
def str13_bibtex_key(s, d):
    own = _details(s, d).where("title is not null and pub_year is not null and get(authors, 0) is not null")
    return own.select("record_id", M.bibtex_key("authors", "pub_year", "title").alias("key"))


@query(r"select record_id, trim(regexp_extract(bibtex, '(?i)publisher\s*=\s*\{(.*?)\},', 1)) publisher from doc_details where bibtex is not null")
def str14_bibtex_field(s, d):
    return _details(s, d).where("bibtex is not null").select("record_id", M.bibtex_field("bibtex", "publisher").alias("publisher"))


_KINDS = ["@BookSection", "@article", "@None", "@misc"]


@query("select record_id, (case record_id % 4 when 0 then '@book' when 3 then '@misc' else '@article' end) || '{r'||record_id||', title={b}}' fixed from doc_details")
def str15_repair_bibtex(s, d):
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("record_id") % 4).cast("int"))
    return _details(s, d).select("record_id", M.repaired_bibtex(F.concat(kind, F.lit("{r"), F.col("record_id").cast("string"), F.lit(", title={b}}"))).alias("fixed"))


@query()
def str16_reference(s, d):
    c = F.col
    return _details(s, d).select("record_id", M.reference_text(c("authors"), c("title"), c("journal"), c("volume"), c("issue"), c("pages"), c("pub_year"), c("doi")).alias("reference"))


@query("select record_id, case bibtex_type when 'book' then 'book' when 'dataset' then 'misc' when 'proceedings' then 'proceedings' when 'journal' then 'misc' when 'report' then 'techreport' else 'article' end kind from doc_details")
def str17_bibtex_type(s, d):
    return _details(s, d).select("record_id", M.bibtex_type("bibtex_type").alias("kind"))


@query(r"select record_id, regexp_replace(trim(a), '^([^,]+),\s*(.+)$', '\2 \1') as name from (select record_id, unnest(authors) a from doc_details) where a is not null")
def str18_given_first(s, d):
    return _details(s, d).select("record_id", F.explode("authors").alias("a")).where("a is not null").select("record_id", T.given_first("a").alias("name"))


@query(r"""select record_id, regexp_replace(substr(title,1,48), '[/\\?%*:|"<>\x7f\x00-\x1f]', '-', 'g')||'_'||dockey as name from doc_details where title is not null""")
def str19_file_name(s, d):
    return _details(s, d).where("title is not null").select("record_id", T.file_name("title", "dockey").alias("name"))


@query("select doc_id, doc_id % 3 = 0 is_irrelevant, coalesce(source,'') as text from documents")
def str20_relevance_label(s, d):
    k, body = F.col("doc_id"), F.coalesce("source", F.lit(""))
    t = F.when(k % 3 == 0, F.concat(F.lit("**IRRELEVANT:** "), body)).when(k % 3 == 1, F.concat(F.lit("RELEVANT: "), body)).otherwise(body)
    return _docs(s, d).select("doc_id", T.relevance_label(t).alias("r")).select("doc_id", "r.is_irrelevant", "r.text")


@query("select item_id, topic||' of things, '||item_id as first, 2::int n from eval_items")
def str21_proposed(s, d):
    t = F.concat(F.lit('1. "'), "topic", F.lit(" of things, "), F.col("item_id").cast("string"), F.lit('"\nab\n2. [second query]'))
    q = T.proposed_queries(t)
    return table(s, d, "eval_items").select("item_id", F.get(q, F.lit(0)).alias("first"), F.size(q).alias("n"))


@query(r"select record_id, lower(regexp_replace(concat_ws('',docname,string_split_regex(trim(title),'\s+')[1],pub_year), '[^\p{L}\p{N}]','','g')) as key from doc_details where title is not null")
def str22_library_key(s, d):
    return _details(s, d).where("title is not null").select("record_id", T.library_key("docname", "title", F.col("pub_year").cast("string")).alias("key"))


@query("select doc_id, coalesce(source,'')||' done' as text from documents")
def str23_thought(s, d):
    return _docs(s, d).select("doc_id", T.without_thought(F.concat(F.lit("<thinking>"), F.coalesce("source", F.lit("")), F.lit("</thinking> done"))).alias("text"))


@query("select doc_id, coalesce(source,'')||' | x' answer, 'Status: '||doc_id status from documents")
def str24_answer_status(s, d):
    t = F.concat(F.coalesce("source", F.lit("")), F.lit(" | x | Status: "), F.col("doc_id").cast("string"))
    return _docs(s, d).select("doc_id", T.answer_status(t).alias("r")).select("doc_id", "r.answer", "r.status")


@query("select item_id, 'Q: '||question||' ('||topic||')' as filled, 'question,topic' as variables from eval_items")
def str25_template(s, d):
    t = "Q: {question} ({topic})"
    return table(s, d, "eval_items").select("item_id", T.fill_template(t, {"question": F.col("question"), "topic": F.col("topic")}).alias("filled"), F.array_join(T.template_variables(F.lit(t)), ",").alias("variables"))


# Dates, numbers, identity, JSON


@query(r"""select paper_id, case when regexp_matches(publication_date,'^\d{4}-\d{2}-\d{2}$') then publication_date end parsed, (case when regexp_matches(publication_date,'^\d{4}-\d{2}-\d{2}$') then substr(publication_date,1,4) end)::int as year from s2_papers""")
def dat1_parse_date(s, d):
    at = M.parse_date("publication_date")
    return table(s, d, "s2_papers").select("paper_id", F.date_format(at, "yyyy-MM-dd").alias("parsed"), F.year(at).alias("year"))


@query("select record_id, strftime(make_date(pub_year, case when record_id%2=0 then 1+record_id%12 else 1 end, 1),'%Y-%m-%d') as day from doc_details where pub_year is not null")
def dat2_date_parts(s, d):
    month = (1 + F.col("record_id") % 12).cast("int")
    parts = F.when(F.col("record_id") % 2 == 0, F.array("pub_year", month)).otherwise(F.array("pub_year"))
    return _details(s, d).where("pub_year is not null").select("record_id", F.date_format(M.date_from_parts(parts), "yyyy-MM-dd").alias("day"))


@query("select record_id, year(retrieved_at)::int as year, split_part(strftime(retrieved_at,'%Y-%m'),'-',1)::int trial_year from doc_details where retrieved_at is not null")
def dat3_year(s, d):
    return _details(s, d).where("retrieved_at is not null").select("record_id", F.year("retrieved_at").alias("year"), F.split_part(F.date_format("retrieved_at", "yyyy-MM"), F.lit("-"), F.lit(1)).cast("int").alias("trial_year"))


@query("select vec_id, round(list_dot_product(embedding::double[], embedding::double[]),5) dot, round(sqrt(list_dot_product(embedding::double[], embedding::double[])),5) norm from embeddings")
def mth1_vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.dot("embedding", "embedding"), 5).alias("dot"), F.round(V.norm("embedding"), 5).alias("norm"))


@query("select l_orderkey, l_linenumber, floor(l_discount*640)::int px, floor(l_tax*480)::int py from lineitem")
def mth2_pixels(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", V.to_pixels("l_discount", 640).alias("px"), V.to_pixels("l_tax", 480).alias("py"))


@query("select p_partkey, round_even(p_size/50.0*10,0)::int score from part")
def mth3_fraction(s, d):
    return table(s, d, "part").select("p_partkey", V.fraction_score("p_size", F.lit(50)).alias("score"))


@query("select record_id, substr(md5(lower(docname)),1,16) encoded, case when coalesce(doi,'')<>'' then substr(md5(lower(lower(doi)||coalesce(dockey,''))),1,16) else substr(md5(lower(dockey)),1,16) end doc_id, 'pqac-'||substr(md5(lower(docname||substr(coalesce(title,''),1,500))),1,8) ctx_id from doc_details where docname is not null")
def hsh1_identity(s, d):
    return _details(s, d).where("docname is not null").select("record_id", M.encode_id("docname").alias("encoded"), M.doc_id("doi", "dockey").alias("doc_id"), M.context_id("docname", F.coalesce("title", F.lit(""))).alias("ctx_id"))


@query("select doc_id, coalesce(source,'') summary, (doc_id % 10)::int relevance_score from documents")
def jsn1_reply(s, d):
    t = F.concat(F.lit('<think>hm</think>```json\n{"summary": "'), F.coalesce("source", F.lit("")), F.lit('",, "relevance score": "'), (F.col("doc_id") % 10).cast("string"), F.lit('/10",}\n```'))
    return _docs(s, d).select("doc_id", R.reply(t).alias("r")).select("doc_id", "r.summary", "r.relevance_score")


def _trial_json():
    k = F.col("doc_id")
    return F.concat(F.lit('{"protocolSection":{"identificationModule":{"nctId":"NCT'), F.lpad(k.cast("string"), 8, "0"), F.lit('","briefTitle":"Trial of '), F.coalesce("source", F.lit("x")), F.lit('","organization":{"fullName":"Org"}},"statusModule":{"overallStatus":"DONE","startDateStruct":{"date":"2019-05"}}}}'))


@query("select doc_id, 'Trial: NCT'||lpad(doc_id::varchar,8,'0')||chr(10)||'Title: Trial of '||coalesce(source,'x')||chr(10)||'Status: DONE'||chr(10)||'Start: 2019-05'||chr(10)||'Completion: Not provided'||chr(10)||'Type: Not provided'||chr(10)||'Phases: Not provided'||chr(10)||'Enrollment: Not provided'||chr(10)||'Sponsor: Not provided'||chr(10)||'Summary: Not provided'||chr(10)||'Description: Not provided'||chr(10)||'Eligibility: Not provided' report from documents")
def jsn2_trial_report(s, d):
    return trials.report(_docs(s, d).select("doc_id", _trial_json().alias("json"))).select("doc_id", "report")


@query("select doc_id, 2019::int as year, 'Org. Trial of '||coalesce(source,'x')||'. ClinicalTrials.gov, 2019. Trial NCT'||lpad(doc_id::varchar,8,'0')||'.' citation from documents")
def jsn3_trial_citation(s, d):
    return trials.citation(_docs(s, d).select("doc_id", _trial_json().alias("json"))).select("doc_id", "year", "citation")


@query("select record_id, array_to_string(list_sort(list_filter(json_keys(other), lambda k: k not in ('title','DOI'))),',') as keys from doc_details where json_valid(other) and other <> ''")
def jsn4_other_keys(s, d):
    raw = _details(s, d).where(F.try_parse_json("other").isNotNull() & (F.col("other") != "")).select("record_id", F.col("other").alias("json"))
    got = providers.unknown_keys(raw, "title string, DOI string")
    return got.select("record_id", F.array_join(F.array_sort(F.map_keys("other")), ",").alias("keys"))


@query("select record_id, 'T'||record_id as title from doc_details")
def jsn5_structured_citation(s, d):
    t = F.concat(F.lit('Here: {"title": "T'), F.col("record_id").cast("string"), F.lit('", "authors": ["A"]} end'))
    return _details(s, d).select("record_id", R.structured_citation(t).getField("title").alias("title"))


# Validation of records


@query(f"select record_id, {_NORMAL.format('doi')} doi from doc_details")
def v1_doi(s, d):
    return _details(s, d).select("record_id", M.normal_doi("doi").alias("doi"))


@query("select record_id, lower(replace(coalesce(nullif(doi_url,''),'https://doi.org/'||nullif(doi,'')),'http://dx.doi.org/','https://doi.org/')) as url from doc_details")
def v2_doi_url(s, d):
    return _details(s, d).select("record_id", M.doi_url("doi_url", "doi").alias("url"))


@query("""select record_id, case when contains(x,'10.48550/') then 'ArXiv' when contains(x,'10.26434/') then 'ChemRxiv' when contains(x,'10.1101/') and length(x)=25 then 'BioRxiv' when contains(x,'10.1101/') and length(x)=27 then 'MedRxiv' when contains(x,'10.31224/') then 'EngRxiv' end journal
from (select record_id, ['10.48550/arxiv.2','10.26434/c','10.1101/2024.01.01.573887','10.1101/2023.10.31.23297','10.1101/2021.04.29.21256344','10.31224/z','10.1000/q'][(record_id%7)::int+1] x from doc_details)""")
def v3_preprint_journal(s, d):
    known = F.array(*[F.lit(x) for x in ("10.48550/arxiv.2", "10.26434/c", "10.1101/2024.01.01.573887", "10.1101/2023.10.31.23297", "10.1101/2021.04.29.21256344", "10.31224/z", "10.1000/q")])
    return _details(s, d).select("record_id", M.preprint_journal(F.lit(None).cast("string"), F.get(known, (F.col("record_id") % 7).cast("int"))).alias("journal"))


@query("select record_id, replace(replace(replace(pages,'-','--'),'--','-'),' ','') pages from doc_details")
def v4_pages(s, d):
    return _details(s, d).select("record_id", M.clean_pages(F.replace("pages", F.lit("-"), F.lit("--"))).alias("pages"))


@query()
def v5_bibtex(s, d):
    c = F.col
    fields = {"title": c("title"), "year": c("pub_year"), "journal": c("journal"), "volume": c("volume"), "doi": c("doi")}
    entry = M.made_bibtex(M.bibtex_key("authors", "pub_year", F.coalesce("title", F.lit("Unknown title"))), c("bibtex_type"), fields, F.coalesce("authors", F.array().cast("array<string>")))
    return _details(s, d).select("record_id", F.when(M.bibtex_complete("bibtex"), c("bibtex")).otherwise(entry).alias("bibtex"))


@query("select record_id, coalesce(nullif(docname,''), dockey) dockey from doc_details")
def v6_overwritten(s, d):
    return _details(s, d).select("record_id", M.overwritten("dockey", "docname", F.array(F.lit("doc_id")), "doc_id").alias("dockey"))


@query("""select record_id, case when is_retracted then '**RETRACTED ARTICLE** '||(case when coalesce(citation,'')<>'' then 'Citation: '||citation else 'Original DOI: '||coalesce(doi,'None') end)||' Retrieved from http://retractiondatabase.org/.'
when citation_count is null or source_quality is null then citation when source_quality=0 then citation||' This article has '||citation_count||' citations and is from a poor quality or predatory journal.' when source_quality=1 then citation||' This article has '||citation_count||' citations and is from a peer-reviewed journal.'
when source_quality=2 then citation||' This article has '||citation_count||' citations and is from a domain leading peer-reviewed journal.' when source_quality=3 then citation||' This article has '||citation_count||' citations and is from a highest quality peer-reviewed journal.' else citation||' This article has '||citation_count||' citations.' end formatted from doc_details""")
def v7_formatted_citation(s, d):
    c = F.col
    return _details(s, d).select("record_id", M.formatted_citation(c("citation"), c("doi"), c("is_retracted"), c("citation_count"), c("source_quality")).alias("formatted"))


@query("select record_id, docname as key from doc_details")
def v8_key(s, d):
    return _details(s, d).select("record_id", M.clean_key(F.concat(F.lit("<i>"), "docname", F.lit("</i>"))).alias("key"))


@query("select record_id, case record_id % 3 when 0 then 'key|doc_id|'||record_id when 1 then 'a, b|c'||record_id else 'x|y' end as parsed from doc_details")
def v9_string_list(s, d):
    k, n = F.col("record_id") % 3, F.col("record_id").cast("string")
    cell = F.when(k == 0, F.concat(F.lit("{'key', \"doc_id\", "), n, F.lit("}"))).when(k == 1, F.concat(F.lit("['a, b', c"), n, F.lit("]"))).otherwise("x,y")
    return _details(s, d).select("record_id", F.array_join(M.string_list(cell), "|").alias("parsed"))


# Chunks


_CHK1 = """(with t as (select text_id dockey, replace(content, chr(12), '') w, content from parsed_texts), p as (select dockey, page_no, (sum(length(text)) over (partition by dockey order by page_no)) upto from PAGES), l as (select dockey, max(page_no) m from p group by 1),
c as (select dockey, w, unnest(range(0, greatest(0, ceil((length(w)-5000)/4750.0))::bigint+1)) i, greatest(0, ceil((length(w)-5000)/4750.0))::bigint n from t),
e as (select c.dockey, c.i, coalesce(min(p.page_no), any_value(l.m)) e from c left join p on p.dockey=c.dockey and p.upto > c.i*4750+5000 join l on l.dockey=c.dockey group by 1,2)
select c.dockey, c.i::int chunk_ix, 'pages '||(case when c.i=0 then 1 else e0.e end)||'-'||(case when c.i=c.n then l.m else e1.e end) as name, md5(substr(w, c.i*4750+1, 5000)) as text from c join l using (dockey) left join e e0 on e0.dockey=c.dockey and e0.i=c.i-1 left join e e1 on e1.dockey=c.dockey and e1.i=c.i)""".replace("PAGES", _PAGES)


@query(f"select * from {_CHK1}")
def chk1_overlap_pages(s, d):
    return chunking.overlap_chunks(_pages(s, d), 5000, 250).withColumn("text", F.md5("text"))


@query("select doc_id dockey, i::int chunk_ix, md5(substr(text, greatest(i*1000-100,0)+1, least((i+1)*1000+100, length(text))-greatest(i*1000-100,0))) as text from (select doc_id, text, unnest(range(0, ceil(length(text)/1000.0)::bigint)) i from documents where length(text)>0)")
def chk2_overlap_text(s, d):
    return chunking.text_chunks(_docs(s, d).select(F.col("doc_id").alias("dockey"), "text"), 1000, 100).withColumn("text", F.md5("text"))


@query("select doc_id dockey, i::int chunk_ix, md5(substr(t, i*900+1, 1000)) as text from (select doc_id, coalesce(text,'') t, unnest(range(0, greatest(0, ceil((length(coalesce(text,''))-1000)/900.0))::bigint+1)) i from documents)")
def chk3_overlap_code(s, d):
    return chunking.code_chunks(_docs(s, d).select(F.col("doc_id").alias("dockey"), "text"), 1000, 100).select("dockey", "chunk_ix", F.md5("text").alias("text"))


@query("select doc_id dockey, 0::int chunk_ix, md5(text) as text from documents")
def chk4_whole(s, d):
    return chunking.whole_texts(_docs(s, d).select(F.col("doc_id").alias("dockey"), F.md5("text").alias("text")))


@query("select doc_id dockey, 0::int chunk_ix, md5(substr(text,1,28000)) as text from documents where doc_kind='trial' union all select -1, 0, md5('Found '||count(*)||' trials') from documents where doc_kind='trial'")
def chk5_trials(s, d):
    t = _docs(s, d).where("doc_kind = 'trial'").select(F.col("doc_id").alias("dockey"), "text")
    told = t.agg(F.count("*").alias("n")).select(F.lit(-1).cast("bigint").alias("dockey"), F.lit(0).alias("chunk_ix"), F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" trials")).alias("text"))
    return chunking.trial_chunks(t, told).withColumn("text", F.md5("text"))


# Sets


@query("select distinct dockey from documents where dockey is not null and dockey not in (select dockey from doc_details where record_id % 3 = 0)")
def set2_stale(s, d):
    return _docs(s, d).where("dockey is not null").select("dockey").subtract(_details(s, d).where("record_id % 3 = 0").select("dockey"))


@query("select doc_id, 'pqac-'||substr(md5(doc_id::varchar),1,8) made_up from documents where source is not null")
def set3_made_up_ids(s, d):
    a, b = F.concat(F.lit("pqac-"), F.substring(F.md5("source"), 1, 8)), F.concat(F.lit("pqac-"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8))
    return _docs(s, d).where("source is not null").select("doc_id", F.array_join(F.array_except(T.citation_ids(F.concat_ws(" ", a, b)), F.array(a)), " ").alias("made_up"))


@query("select doc_id, (contains(text,'results'))::int + (contains(text,'trial'))::int n from documents where text is not null")
def set4_used_contexts(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.size(F.filter(F.array(F.lit("results"), F.lit("trial")), lambda x: F.contains(F.col("text"), x))).alias("n"))


@query("select record_id, array_to_string(list_sort(list_intersect(json_keys(other), ['funder','topics','language'])),',') shared from doc_details where json_valid(other) and other <> ''")
def set5_shared_keys(s, d):
    own = _details(s, d).where(F.try_parse_json("other").isNotNull() & (F.col("other") != ""))
    return own.select("record_id", F.array_join(F.array_sort(F.array_intersect(F.json_object_keys("other"), F.array(F.lit("funder"), F.lit("topics"), F.lit("language")))), ",").alias("shared"))


@query("select distinct source, lang from documents")
def set7_distinct(s, d):
    return _docs(s, d).select("source", "lang").dropDuplicates()


# Answers and helpers


@query()
def udf3_sparse_embedding(s, d):
    return _docs(s, d).select("doc_id", models.embedding("sparse")("text").alias("v")).select("doc_id", F.array_join("v", ",").alias("vector"))


@query("select doc_id, md5(trim(text, chr(10))) context, 5::int score from documents where text is not null")
def udf4s_skip_summary(s, d):
    return models.skip_summary(_docs(s, d).where("text is not null")).select("doc_id", F.md5("context").alias("context"), "score")


@query("select doc_id, case when regexp_matches(coalesce(text,''),'^(NCT|XCT)[0-9]{8}') then 1 else 0 end part from documents")
def udf5_partition(s, d):
    return _docs(s, d).select("doc_id", trials.is_trial(F.coalesce("text", F.lit(""))).alias("part"))


@query(f"select question, md5(string_agg(ctx_id||': '||context, chr(10)||chr(10) order by ctx_id)) section, min(ctx_id) as first from (select * from {_CONTEXTS} where score>=1) group by question")
def ans2_context(s, d):
    c = _contexts(s, d).where("score >= 1").withColumn("line", F.concat_ws(": ", F.col("ctx_id").cast("string"), "context"))
    return aggregates.sections(c, "question", "ctx_id", "line").withColumn("section", F.md5("section"))


@query("select doc_id::varchar as session, 'As shown (chunk '||doc_id||').' answer, '1. (chunk '||doc_id||'): '||coalesce(source,'') bibliography from documents where text <> ''")
def ans4_cited(s, d):
    c = _docs(s, d).where("text <> ''").select(F.col("doc_id").cast("string").alias("session"), F.concat(F.lit("pqac-"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8)).alias("ctx_id"), F.concat(F.lit("chunk "), F.col("doc_id").cast("string")).alias("name"), F.coalesce("source", F.lit("")).alias("citation"))
    answers = c.select("session", F.concat(F.lit("As shown ("), "ctx_id", F.lit(", pqac-00000000).")).alias("raw_answer"))
    return answering.cited(answers, c.select("ctx_id", "name", F.col("session").alias("dockey")), c.select(F.col("session").alias("dockey"), "citation"))


@query()
def hlp2_title_lookup(s, d):
    a = table(s, d, "s2_papers").where("paper_id % 100 = 0").select(F.col("paper_id").alias("asked_id"), F.col("title").alias("asked_title"))
    return providers.by_title(a, _details(s, d).select("record_id", "title")).select("asked_id", "record_id", F.round("similarity", 6).alias("similarity"))


@query(f"select a.record_id asked_id, b.record_id from doc_details a join doc_details b on lower(a.doi) = {_NORMAL.format('b.doi')} where a.record_id % 100 = 0")
def hlp3_doi_lookup(s, d):
    r = _details(s, d)
    return providers.by_doi(r.where("record_id % 100 = 0").select(F.col("record_id").alias("asked_id"), F.col("doi").alias("asked_doi")), r.select("record_id", M.normal_doi("doi").alias("doi"))).select("asked_id", "record_id")


@query("select record_id, coalesce(contains(bibtex,'doi=') and contains(bibtex,'title='), false) complete from doc_details")
def hlp5_bibtex_complete(s, d):
    return _details(s, d).select("record_id", M.bibtex_complete("bibtex").alias("complete"))


@query("select record_id, coalesce(client_source||',','')||'self_generated' as sources from doc_details")
def hlp6_source_list(s, d):
    own = F.filter(F.array("client_source"), lambda x: x.isNotNull())
    return _details(s, d).select("record_id", F.array_join(M.appended_source(own, "self_generated"), ",").alias("sources"))


@query("select doc_id, 'data:image/png;base64,'||base64(encode(source)) as url from documents where source is not null")
def hlp10_data_url(s, d):
    return _docs(s, d).where("source is not null").select("doc_id", T.data_url(F.col("source").cast("binary")).alias("url"))
