"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

_OP4 = f"""
with counts as (
  select source, lang, 'words-1' as tokenizer, len({_WORDS})::BIGINT as n from documents
  union all
  select source, lang, 'utf8-bytes-1', coalesce(octet_length(encode(text)), 0)::BIGINT from documents
)
select source, lang, tokenizer, count(*)::BIGINT as docs, sum(n)::BIGINT as tokens from counts group by all
"""

_OP9 = f"""
with docs as (select doc_id, {_WORDS} as ws from documents),
windows as (select doc_id, i as start, array_to_string(ws[i:i + 19], ' ') as w from docs, unnest(range(1, len(ws) - 18)) as t(i)),
later as (select doc_id, start from (select *, row_number() over (partition by w order by doc_id, start) as n from windows) where n > 1),
gone as (select distinct doc_id, p from later, unnest(range(start, start + 20)) as t(p)),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from docs),
marked as (select words.*, gone.p is not null as cut from words left join gone using (doc_id, p)),
kept as (select doc_id, count(*) filter (cut) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (not cut), '') as text from marked group by 1)
select doc_id, len(ws)::BIGINT as n_words, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from docs left join kept using (doc_id)
"""

_OP10 = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT as score from vectors q join vectors c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::INTEGER as rank, vec_id, score from scored qualify rank <= 20
"""

SQL = {"op4_token_counts": _OP4, "op9_substring_dedup": _OP9, "op10_topk_search": _OP10}
