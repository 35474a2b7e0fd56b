"""DuckDB SQL for the queries that SQL can express."""

SQL = {
    # all pairs and their transitive closure: right wherever the graph search misses no link
    "op10_pruned_graph": """
with recursive unit as (
    select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
    where vec_id is not null and embedding is not null
      and list_count(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links as (
    select a.vec_id as a, b.vec_id as b from unit a, unit b
    where a.vec_id <> b.vec_id
      and list_dot_product(a.v, b.v)
          / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95),
reach as (
    select a, b from links
    union
    select r.a, l.b from reach r join links l on r.b = l.a),
counted as (select a, count(*) as n_links from links group by a),
least as (select a, min(b) as b from reach group by a)
select e.vec_id, coalesce(c.n_links, 0) as n_links,
       least(e.vec_id, coalesce(l.b, e.vec_id)) as component_id,
       e.vec_id <= coalesce(l.b, e.vec_id) as kept, null::double as audited_recall
from embeddings e left join counted c on c.a = e.vec_id left join least l on l.a = e.vec_id
""",
    "op11_stratified_search": r"""
with words as (
    select d, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as d, doc_id, text from documents)),
asked as (
    select distinct item_id, text, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark),
lengths as (select d, any_value(doc_id) as doc_id, count(*) as n from words group by d),
totals as (select count(*) as docs, sum(n)::bigint as occurrences from lengths),
postings as (select d, term, count(*) as tf from words group by d, term),
weights as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
    from (select term, count(*) as df from postings group by term), totals),
scored as (
    select a.item_id, a.text, l.doc_id, l.d,
           sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (
               100 - 50 + ((50 * l.n * t.docs) // t.occurrences)))))::bigint as score
    from asked a join postings p using (term) join weights w using (term)
         join lengths l using (d), totals t
    group by a.item_id, a.text, l.doc_id, l.d),
ranked as (
    select item_id, row_number() over (partition by item_id, text
                                       order by score desc, doc_id) as rank, doc_id, score
    from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
""",
    "op12_count_streams": r"""
with pieces as (
    select lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as words
    from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
          from documents)),
places as (select lang, p, unnest(words) as w, generate_subscripts(words, 1) as i from pieces),
runs as (
    select lang, w as w1, lead(w, 1) over piece as w2, lead(w, 2) over piece as w3
    from places window piece as (partition by p order by i)),
counted as (
    select lang, 1 as k, w1, null as w2, null as w3, count(*) as f from runs group by lang, w1
    union all
    select lang, 2, w1, w2, null, count(*) from runs where w2 is not null group by lang, w1, w2
    union all
    select lang, 3, w1, w2, w3, count(*) from runs where w3 is not null
    group by lang, w1, w2, w3),
ones as (select lang, w1, f from counted where k = 1),
twos as (select lang, w1, w2, f from counted where k = 2),
totals as (select lang, sum(f) as n from ones group by lang),
cuts as (
    select c.lang, c.w1, c.w2, null as w3, c.f as a, 1 as cut, x.f as l, y.f as r
    from twos c join ones x on x.lang = c.lang and x.w1 = c.w1
    join ones y on y.lang = c.lang and y.w1 = c.w2 where c.f >= 10
    union all
    select c.lang, c.w1, c.w2, c.w3, c.f, 1, x.f, y.f
    from counted c join ones x on x.lang = c.lang and x.w1 = c.w1
    join twos y on y.lang = c.lang and y.w1 = c.w2 and y.w2 = c.w3 where c.k = 3 and c.f >= 10
    union all
    select c.lang, c.w1, c.w2, c.w3, c.f, 2, x.f, y.f
    from counted c join twos x on x.lang = c.lang and x.w1 = c.w1 and x.w2 = c.w2
    join ones y on y.lang = c.lang and y.w1 = c.w3 where c.k = 3 and c.f >= 10),
scored as (
    select *, (1000000 * a::hugeint * a::hugeint) // (l::hugeint * r::hugeint) as score
    from cuts),
weakest as (
    select * from scored
    qualify row_number() over (partition by lang, w1, w2, w3 order by score, cut) = 1),
longest as (
    select lang, w1, w2, max(f) as f from (
        select lang, w1, w2, f from counted where k = 3 and f >= 10
        union all
        select lang, w2, w3, f from counted where k = 3 and f >= 10)
    group by lang, w1, w2),
kept as (
    select w.*, concat_ws(' ', w.w1, w.w2, w.w3) as phrase
    from weakest w left join longest o on o.lang = w.lang and o.w1 = w.w1 and o.w2 = w.w2
    where w.w3 is not null or o.f is null or 100 * o.f < 50 * w.a),
ranked as (select *, row_number() over (partition by lang
                                        order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
""",
}
