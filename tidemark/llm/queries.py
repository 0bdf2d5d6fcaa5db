"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tidemark.llm import byte_bpe, collocations, disclosure, fingerprints, infill, jaccard_groups, language, licences, lines, media, packing, simhash, substring_index


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.remove_repeats(_documents(spark, sf_dir), texts_too=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_boilerplate(_documents(spark, sf_dir), "source")
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256)
    return found.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_documents(spark, sf_dir), path, keep_ids=False).drop("ids")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_documents(spark, sf_dir)).drop("media", "tile")


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digests(disclosure.find_spans(_documents(spark, sf_dir)))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.similar_documents(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.transform(_documents(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_substring_dedup,
        op3_language_id,
        op4_licence_scan,
        op5_byte_bpe,
        op6_line_dedup,
        op7_packing,
        op8_simhash,
        op9_media,
        op10_disclosure,
        op11_jaccard_join,
        op12_collocations,
        op13_infill,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op2_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) as h
                from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20)),
        later as (select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as r from win) where r > 1),
        gone as (select distinct doc_id, unnest(range(s, s + 20)) as i from later),
        lists as (select doc_id, list(i) as gone from gone group by doc_id),
        kept as (select d.doc_id, w, case when gone is null then w
                     else list_filter(w, lambda x, i: not list_contains(gone, i)) end as k
                 from d left join lists using (doc_id))
        select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - len(k) as bigint) as n_removed,
               sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept""",
    "op6_line_dedup": """
        with d as (select doc_id, text, coalesce(source, '') as host, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        pages as (select distinct host, text from d where text is not null),
        totals as (select host, count(*) as total from pages group by host),
        lines as (select host, text, unnest(list_distinct(string_split(text, chr(10)))) as line from pages),
        bad as (select host, line from (select host, line, count(*) as n from lines where length(trim(line)) > 0 group by host, line)
                join totals using (host) where n >= 5 and n > 0.1 * total),
        lists as (select host, list(line) as bad from bad group by host),
        kept as (select doc_id, text, ls, list_filter(ls, lambda x: not (length(trim(x)) > 0 and coalesce(list_contains(bad, x), false))) as k
                 from d left join lists using (host))
        select doc_id, cast(case when text is null then 0 else len(ls) end as bigint) as n_lines,
               cast(case when text is null then 0 else len(ls) - len(k) end as bigint) as n_removed,
               sha256(case when text is null then '' else array_to_string(k, chr(10)) end) as kept_sha256 from kept""",
    "op11_jaccard_join": r"""
        with recursive d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                  else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as g from d),
        n as (select doc_id, cast(len(g) as bigint) as n from s),
        t as (select doc_id, unnest(g) as g from s),
        inter as (select a.doc_id as a, b.doc_id as b, count(*) as i from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by all),
        half as (select a, b from inter join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 90 * (x.n + y.n - i)),
        links as (select a, b from half union all select b, a from half),
        reach as (select doc_id, doc_id as c from n union select r.doc_id, b from reach r join links on c = a),
        comp as (select doc_id, min(c) as component_id from reach group by doc_id),
        degree as (select a, count(*) as k from links group by a)
        select doc_id, n as n_shingles, component_id, coalesce(k, 0) as n_links
        from n join comp using (doc_id) left join degree on a = doc_id""",
    "op12_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
        g as (select lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) as g from w, (select unnest([1, 2, 3, 4, 5]) as k)),
        total as (select lang, sum(len(w)) as n from w group by lang),
        f as (select lang, k, g, count(*) as a from g group by lang, k, g having count(*) >= 100),
        cuts as (select lang, k, g, a, unnest(range(1, k)) as c from f where k > 1),
        scores as (select x.lang, x.k, x.g, x.a, c, y.a as l, z.a as r, n, (1000::hugeint * x.a * n) // (y.a::hugeint * z.a) as score
                   from cuts x join f y on x.lang = y.lang and x.g[1:c] = y.g join f z on x.lang = z.lang and x.g[c + 1:] = z.g join total on total.lang = x.lang),
        best as (select * from scores qualify row_number() over (partition by lang, g order by score, c) = 1),
        inner_ as (select lang, g[i:i + m - 1] as g, max(a) as o from
                    (select lang, g, a, m, unnest(range(1, k - m + 2)) as i from (select lang, k, g, a, unnest(range(2, k)) as m from f where k > 2)) group by all),
        kept as (select best.lang, array_to_string(best.g, ' ') as phrase, a, l, r, n, score from best
                 left join inner_ on best.lang = inner_.lang and best.g = inner_.g where o is null or 100 * o < 100 * a)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
               cast(n as bigint) as n, cast(score as bigint) as score from kept
        qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000""",
    "op13_infill": r"""
        with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as ls,
                     [cast('0x' || substr(h, i, 8) as bigint) for i in [1, 9, 17, 25]] as h from d),
        c as (select *, cast(len(ls) as bigint) as n from u),
        p as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as i, greatest(h[1] % (n + 1), h[2] % (n + 1)) as j,
                     case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain'
                          when h[4] % 100 < 50 then 'spm' else 'psm' end as form from c),
        x as (select *, array_to_string(ls[1:i], '') as a, array_to_string(ls[i + 1:j], '') as m, array_to_string(ls[j + 1:], '') as b from p)
        select doc_id, n, form, case when form <> 'plain' then cast(length(a) as bigint) end as prefix_chars,
               case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || b || '<M>' || m
                      else '<S>' || b || '<P>' || a || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from x""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
