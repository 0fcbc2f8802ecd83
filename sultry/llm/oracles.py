"""DuckDB SQL of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

FILTER_AUDIT = r"""
with letters as (select unnest(['A', 'B', 'C', 'D', 'E']) l),
  orders as (select a.l || b.l || c.l || d.l || e.l filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
  steps as (select filter_order, unnest([1, 2, 3, 4, 5]) step from orders),
  texts as (select doc_id, coalesce(source, '') part, coalesce(text, '') text from documents),
  words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w, min(doc_id) over (partition by text) least from texts),
  fails as (select doc_id, part,
      (case when len(w) < 50 then 'A' else '' end)
      || (case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end)
      || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 'C' else '' end)
      || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end)
      || (case when doc_id > least then 'E' else '' end) failed from words),
  known as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
  counts as (select part, failed, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from fails left join known using (doc_id) group by all),
  judged as (select part, filter_order, step, failed, n, good, toxic,
      contains(failed, substr(filter_order, step, 1)) has,
      step > 1 and len(list_intersect(string_split(substr(filter_order, 1, step - 1), ''), string_split(failed, ''))) > 0 and failed <> '' met
    from counts, steps)
select part, filter_order, step::int step,
  sum(case when not has and not met then n else 0 end)::bigint kept,
  sum(case when has and not met then n else 0 end)::bigint removed,
  sum(case when has and met then n else 0 end)::bigint redundant,
  sum(case when has and length(failed) = 1 then n else 0 end)::bigint unique_fails,
  sum(case when has and not met then good else 0 end)::bigint good_lost,
  sum(case when has and not met then toxic else 0 end)::bigint toxic_lost,
  sum(case when has then 120 * n // length(failed) else 0 end)::bigint shapley
from judged group by all
"""

HARD_NEGATIVES = r"""
with given as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v, embedding
    from embeddings where vec_id is not null and label is not null and embedding is not null),
  vectors as (select distinct vec_id, label, v from given where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  scored as (select a.vec_id anchor_id, b.vec_id other_id, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score
    from vectors a join vectors b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
  positives as (select anchor_id, other_id positive_id, score positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, other_id))::int rank, other_id negative_id, positive_score, score negative_score
from positives join scored using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 3
"""

SQL: dict[str, str] = {"op12_filter_audit": FILTER_AUDIT, "op13_hard_negatives": HARD_NEGATIVES}
