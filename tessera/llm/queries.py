"""The queries of the operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import decontaminate, fixity, html_text, lang_id, licenses, line_dedup, neardup, packing, quality, spelling, token_counts, url_lists, vector_codes
from .shared import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("estimate")


def _digits(column: str) -> F.Column:
    """A number below 2**28 from the md5 of a string."""
    return F.conv(F.substring(F.md5(F.col(column)), 1, 7), 16, 10).cast("long")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are all pages, fetched on a day set by page_id; entries are dated by the md5 of each host."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url", day(F.col("page_id") * 37 % 365).alias("fetched_at"))
    hosts = captures.select(url_lists.url_host(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("h", _digits("host"))
    entry = lambda name, verdict, pattern, action, n: F.struct(*(c.alias(k) for k, c in zip(("list_name", "verdict", "pattern", "action", "at"), (F.lit(name), F.lit(verdict), pattern, F.lit(action), day(n)))))
    h, host = F.col("h"), F.col("host")
    spam = F.array(
        entry("spam", "block", host, "add", h % 300),
        entry("spam", "block", host, "remove", h % 300 + 40 + h % 50),
        entry("trusted", "allow", F.concat(host, F.lit("/en")), "add", h % 200),
        entry("adult", "block", F.concat(host, F.lit("/de")), "add", h % 100),
    )
    events = hosts.where("h % 4 = 0").select(F.inline(spam)).unionByName(spark.sql("select 'suspended' list_name, 'block' verdict, 'example.com' pattern, 'add' action, date'2024-06-01' at union all select 'suspended', 'block', 'example.com', 'remove', date'2024-06-15'"))
    return url_lists.filter_captures(captures, events)


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of archive files of 256 ids; the second replica has damage set by the md5 of page_id."""
    payload, fate = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")), F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id div 256").alias("file"), payload.alias("payload"), fate.alias("fate"))
    other = F.when(F.col("fate") == "01", F.concat(F.lit("X"), F.expr("substring(payload, 2)"))).when(F.col("fate") == "02", F.expr("left(payload, length(payload) - 1)")).otherwise(F.col("payload"))
    told = lambda name, c: [fixity.record_hash(c).alias(f"{name}_hash"), fixity.record_bytes(c).alias(f"{name}_bytes")]
    # hashed where they lie: what is placed and compared is some 150 bytes a record
    hashed = pages.select("page_id", "file", "fate", *told("left", F.col("payload")), *told("right", other))
    before = Window.partitionBy("file").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(hashed.withColumn("offset", F.coalesce(F.sum("left_bytes").over(before), F.lit(0))), "placed-records")
    side = lambda rows, name: rows.select("file", "offset", F.col(f"{name}_hash").alias("hash"), F.col(f"{name}_bytes").alias("bytes"))
    return fixity.audit_replicas(side(placed, "left"), side(placed.where("fate <> '00'"), "right"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of projects of 200 ids with four modules; every 50th is a licence file."""
    name = F.when(F.col("doc_id") % 50 == 0, "LICENSE").otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    module = F.when(F.col("doc_id") % 200 == 0, F.lit("")).otherwise(F.concat(F.lit("/m"), F.expr("cast(doc_id div 50 % 4 as string)")))
    path = F.concat(F.lit("p"), F.expr("cast(doc_id div 200 as string)"), module, F.lit("/"), name)
    return licenses.scan_licenses(table(spark, sf_dir, "documents").withColumn("path", path))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify_languages(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def _s_round(k: int) -> str:
    """SQL: a<k>, each part's nearest entry in b<k>, and b<k + 1>, the entries moved to their means."""
    return (
        f"a{k} as materialized (select p.r, p.part, any_value(x) as x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint * 64 + e) as best from p join b{k} using (part) group by p.r, p.part), "
        f"m{k} as (select part, best % 64 as e, i, sum(x[i])::bigint as s, count(*) as n from a{k}, unnest(range(1, len(x) + 1)) as t(i) group by all), "
        f"n{k} as (select part, e, list((s - ((s % n) + n) % n) // n order by i) as c from m{k} group by all), "
        f"b{k + 1} as materialized (select part, e, coalesce(n{k}.c, b{k}.c) as c from b{k} left join n{k} using (part, e)), "
    )


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_url_filters": op2_url_filters,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_token_counts": op11_token_counts,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {
    "op1_benchmark_decontamination": """
        with dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
        ds as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from dw)),
        bw as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from benchmark),
        bs as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 3)) as i from bw)),
        n as (select item_id, count(*) as n_shingles from bs group by 1)
        select doc_id, item_id, n_shingles, count(*) as n_found from ds join bs using (s) join n using (item_id) group by all having 100 * count(*) >= 80 * n_shingles""",
    "op7_minhash_near_dedup": """
        with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as materialized (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, case when len(w) > 0 then 2 else 1 end))) as i from w)),
        n as materialized (select w.doc_id, count(s.s) as n from w left join s using (doc_id) group by 1),
        l as materialized (select a.doc_id as u, b.doc_id as v from s a join s b on a.s = b.s and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
              where least(x.n, y.n) * 100 >= 85 * greatest(x.n, y.n) group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        r as (select doc_id as u, doc_id as v from documents union select r.u, l.v from r join l on l.u = r.v)
        select n.doc_id, n.n as n_shingles, min(r.v) as component_id, n.doc_id = min(r.v) as kept from n join r on r.u = n.doc_id group by n.doc_id, n.n""",
    "op9_quality_rules": """
        with w as materialized (select doc_id, lang as st, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
        g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
        d as (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, s) as c from g) where c > 1),
        v as (select doc_id, count(distinct p) as n from d group by 1),
        c as materialized (select w.doc_id, st, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(v.n, 0) as n_repeat_words,
              len(l) as n_lines, len(regexp_extract_all(t, '\\p{Lu}')) as n_upper, len(regexp_extract_all(t, '[!?]')) as n_marks from w left join v using (doc_id)),
        r as materialized (select doc_id, st, {'symbol_ratio': case when word_chars > 0 then n_symbols / word_chars else 0 end, 'dup_line_ratio': case when n_lines > 0 then n_dup_lines / n_lines else 0 end, 'repeat_ratio': case when n_words > 0 then n_repeat_words / n_words else 0 end,
              'word_length': case when n_words > 0 then word_chars / n_words else 0 end, 'upper_ratio': case when word_chars > 0 then n_upper / word_chars else 0 end, 'mark_ratio': case when word_chars > 0 then n_marks / word_chars else 0 end} as x from c),
        e as materialized (select doc_id, st, unnest(['symbol_ratio', 'dup_line_ratio', 'repeat_ratio', 'word_length', 'upper_ratio', 'mark_ratio']) as rule, unnest([x.symbol_ratio, x.dup_line_ratio, x.repeat_ratio, x.word_length, x.upper_ratio, x.mark_ratio]) as x from r),
        one as (select doc_id, min(quality) > 0 as good from labels where doc_id is not null and quality is not null group by 1),
        y as materialized (select e.*, good, substr(md5(doc_id::varchar), 1, 1) < '8' as proposes from e join one using (doc_id)),
        qs as materialized (select st, rule, quantile_cont(x, [0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0]) as q from y where proposes and good group by all),
        o as (select st, rule, unnest(list_distinct(q)) as cutoff from qs),
        h as materialized (select y.st, y.rule, cutoff, count(*) filter (good) as n, count(*) filter (good and x > cutoff) as k, count(*) filter (not good) as b, count(*) filter (not good and x > cutoff) as hit
              from y join o on y.st is not distinct from o.st and y.rule = o.rule where not proposes group by all),
        lv as materialized (select *, (6 - level) * 6 + list_position(['symbol_ratio', 'mark_ratio', 'dup_line_ratio', 'repeat_ratio', 'upper_ratio', 'word_length'], rule) - 1 as step from (select st, rule, unnest(q) as low, unnest(range(len(q))) as level from qs)),
        dv as materialized (select y.st, doc_id, min(step) filter (x > low) as first from y join lv on y.st is not distinct from lv.st and y.rule = lv.rule where good and not proposes group by all),
        tl as (select st, step, count(*) as n, count(*) filter (first <= step) as k from dv, range(42) as r(step) group by all),
        ft as (select st, step, k <= floor(n * 0.05) and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(1 - 0.05))))
              <= 0.05 / (select greatest(1, count(distinct coalesce(st, chr(0)))) from h) as fits from tl),
        fl as (select st, min(step) filter (not fits) as failed from ft group by 1),
        mn as (select lv.st, rule, min(low) as low from lv join fl on lv.st is not distinct from fl.st where failed is null or step < failed group by all),
        u as (select h.st, h.rule, arg_max(cutoff, (hit, -k, cutoff)) as cutoff from h join mn on h.st is not distinct from mn.st and h.rule = mn.rule where cutoff >= low and hit > 0 and hit * n >= 10 * k * b group by all),
        f as (select e.doc_id, bool_or(x > cutoff) as rejected from e join u on e.st is not distinct from u.st and e.rule = u.rule group by 1)
        select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
          not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(rejected, false) as kept from c left join f using (doc_id)""",
    "op2_url_filters": """
        with c as (select page_id as capture_id, url, date '2024-01-01' + cast(page_id * 37 % 365 as integer) as fetched_at,
                     nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^www\\.|\\.$', '', 'g'), '') as host,
                     list_filter(string_split(regexp_extract(trim(url), '^[^:/?#]+://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages),
        h as (select host, ('0x' || substr(md5(host), 1, 7))::bigint as h from (select distinct host from c where host is not null)),
        e as (select 'spam' as list_name, 'block' as verdict, host as pattern, 'add' as action, date '2024-01-01' + cast(h % 300 as integer) as t from h where h % 4 = 0
              union select 'spam', 'block', host, 'remove', date '2024-01-01' + cast(h % 300 + 40 + h % 50 as integer) from h where h % 4 = 0
              union select 'trusted', 'allow', host || '/en', 'add', date '2024-01-01' + cast(h % 200 as integer) from h where h % 4 = 0
              union select 'adult', 'block', host || '/de', 'add', date '2024-01-01' + cast(h % 100 as integer) from h where h % 4 = 0
              union select 'suspended', 'block', 'example.com', 'add', date '2024-06-01'
              union select 'suspended', 'block', 'example.com', 'remove', date '2024-06-15'),
        v as (select *, lead(t) over (partition by list_name, verdict, pattern order by t, action) as ends from e),
        k as (select c.*, unnest(list_distinct(list_concat(
                list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
                list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(list_slice(parts, 1, i), '/'))))) as pattern from c where host is not null),
        m as (select k.capture_id, v.list_name, v.verdict, v.pattern,
                row_number() over (partition by k.capture_id order by length(v.pattern) desc, (v.verdict = 'allow') desc, v.pattern desc) as r
              from k join v on k.pattern = v.pattern and v.action = 'add' and v.t <= k.fetched_at and (v.ends is null or (v.ends > v.t and k.fetched_at < v.ends))),
        g as (select capture_id, count(*) as n_active, list_sort(list_distinct(list(list_name))) as lists, max(pattern) filter (r = 1) as pattern, max(verdict) filter (r = 1) as verdict from m group by 1)
        select c.capture_id, c.fetched_at, c.host, coalesce(n_active, 0) as n_active, coalesce(lists, []::varchar[]) as lists, pattern, coalesce(verdict, 'none') as decision
        from c left join g using (capture_id)""",
    "op3_warc_fixity": """
        with r as (select page_id, page_id // 256 as file, substr(md5(page_id::varchar), 1, 2) as fate,
                     'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                     || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as payload from pages),
        p as (select *, cast(coalesce(sum(strlen(payload)) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from r),
        d as (select file, pos, case when fate = '01' then 'X' || substr(payload, 2) when fate = '02' then left(payload, length(payload) - 1) else payload end as payload from p where fate <> '00')
        select p.file, p.pos as "offset", case when d.payload is null then 'missing' else 'changed' end as kind, sha256(p.payload) as left_hash, sha256(d.payload) as right_hash,
          cast(strlen(p.payload) as bigint) as left_bytes, cast(strlen(d.payload) as bigint) as right_bytes
        from p left join d using (file, pos) where d.payload is null or d.payload <> p.payload""",
    "op12_vector_codes": f"""
        with v as materialized (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as materialized (select r, part, list_slice(v, part * (len(v) // 16) + 1, (part + 1) * (len(v) // 16)) as x from v, unnest(range(16)) as t(part)),
        b0 as materialized (select part, r - 1 as e, x as c from p where r <= 64),
        {_s_round(0)}{_s_round(1)}
        a2 as materialized (select p.r, p.part, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint * 64 + e) as best from p join b2 using (part) group by p.r, p.part),
        g as (select r, string_agg(printf('%02x', best % 64), '' order by part) as code, sum(best // 64)::bigint as error from a2 group by 1)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) from b2) as codebooks_sha256 from v join g using (r)""",
    "op13_spelling_variants": """
        with recursive crc as materialized (select list(list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) as r(i)),
        d as materialized (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n
          from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) as r from documents) group by all),
        h as materialized (select d.*, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || w, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)),
          lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295::bigint), 4294967295) as h from d, crc),
        c as materialized (select case when h % 199 = 0 then left(w, (h % length(w))::integer) || substr(w, (h % length(w))::integer + 2) else w end as word, sum(n)::bigint as n from h group by 1 having length(word) >= 6 and sum(n) >= 5),
        k as materialized (select word, n, i, left(word, i::integer - 1) || substr(word, i::integer + 1) as gap from c, unnest(range(1, length(word) + 1)) as u(i)),
        pairs as (select distinct a.word as word, b.word as other, b.n as other_n from k a join k b on a.gap = b.gap and a.i = b.i and a.word <> b.word),
        less as (select distinct k.word, k.n, c.word as other, c.n as other_n from k join c on c.word = k.gap),
        near as materialized (select * from pairs union all select word, other, other_n from less union all select other, word, n from less),
        best as (select word, count(*) as n_near, arg_min({'o': other, 'n': other_n}, (-other_n, encode(other))) as b from near group by 1),
        f as materialized (select c.word, c.n, coalesce(n_near, 0) as n_near, case when b.n >= 5 * c.n then b.o end as form, case when b.n >= 5 * c.n then b.n end as form_n from c left join best using (word)),
        walk as (select word, word as at, form as next from f union all select walk.word, walk.next, f.form from walk join f on f.word = walk.next)
        select f.word, f.form, walk.at as root, f.n, f.n_near, f.form_n from f join walk on walk.word = f.word and walk.next is null""",
}
