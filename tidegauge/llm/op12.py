"""Query: damaged conversations and their cheapest repairs."""
from pyspark.sql import functions as F

from tidegauge.llm import turn_repair as R
from tidegauge.llm.catalog import query, table

SQL = r"""
with recursive crc_table as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
r as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
z as (select conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) % 20 z from r, crc_table),
d as (select conv_id, turn, case when z = 4 then 'user' else role end role, case when z = 1 then '' when z = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text,
  unnest(range(case z when 0 then 0 when 3 then 2 else 1 end)) copy from z),
o as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) p from d),
s as (select *, row_number() over (partition by conv_id, role, text order by p) > 1 seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') shown, lag(role[1:1]) over (partition by conv_id order by p) before from o),
f as (select conv_id, turn, role, text, p, before, case when shown = '' then 'b' when seen then 'd' when right(shown, 1) not in ('.', '!', '?') then 't' else '-' end fault from s),
moves as (select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(q, x, q2)),
ins as (select * from (values (0,0,0,''),(0,2,2,'I'),(0,3,4,'II'),(1,1,0,''),(1,2,2,'I'),(1,3,4,'II'),(2,2,0,''),(2,3,2,'I'),(3,3,0,''),(3,2,2,'I')) v(q, q2, c, a)),
opt as (select conv_id, p, q, q q2, 3 c, 'D' a from f, (values (0), (1), (2), (3)) v(q)
  union all select conv_id, p, q, q2, (fault = 't')::int, 'K' from f join moves on x = role[1:1] where fault not in ('b', 'd')
  union all select conv_id, p, q, q2, 2 + (fault = 't')::int, 'R' from f, moves where x in ('u', 'a') and fault not in ('b', 'd')),
step as (select conv_id, p, o.q, i.q2, o.c + i.c c, o.a || i.a a from opt o join ins i on o.q2 = i.q),
dp(conv_id, p, q, best) as (select conv_id, 0::bigint, q2, printf('%09d', c) || a from (select distinct conv_id from f), ins where q = 0
  union all select dp.conv_id, dp.p + 1, step.q2, min(printf('%09d', dp.best[1:9]::bigint + c) || dp.best[10:] || a)
  from dp join step on dp.conv_id is not distinct from step.conv_id and dp.p + 1 = step.p and dp.q = step.q group by all),
n as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate,
  count(*) filter (fault = 't') truncated, count(*) filter (p > 1 and before || role[1:1] not in ('su', 'ua', 'au')) illegal from f group by 1),
best as (select n.conv_id, min(best) best from dp join n on dp.conv_id is not distinct from n.conv_id and p = n.n where q in (0, 3) group by 1),
e as (select conv_id, i, best[i:i] a from (select conv_id, best, unnest(range(10, length(best) + 1)) i from best)),
x as (select conv_id, a, i, count(*) filter (a <> 'I') over w p, count(*) filter (a <> 'D') over w k, count(*) filter (a <> 'D') over (partition by conv_id) total from e window w as (partition by conv_id order by i)),
m as (select x.conv_id, i, case when a = 'K' then role when (k - 1) % 2 = total % 2 then 'user' else 'assistant' end || ':' || case when a = 'I' then '' else text end line
  from x left join f on x.conv_id is not distinct from f.conv_id and x.p = f.p where a <> 'D'),
h as (select conv_id, string_agg(line, chr(10) order by i) repaired from m group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
 coalesce(best[1:9]::bigint, 0)::bigint cost, coalesce(best[10:], '') audit, sha256(coalesce(repaired, '')) repaired_sha256
from (select distinct conv_id from conversations) c left join n on c.conv_id is not distinct from n.conv_id left join best on c.conv_id is not distinct from best.conv_id
 left join h on c.conv_id is not distinct from h.conv_id
"""


def damaged(conversations):
    """The rows with faults by crc32 of ``conv_id:turn``: dropped, emptied, without ends of sentences, repeated, or as the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("z"))
    times = F.array_repeat(F.lit(0), F.when(F.col("z") == 0, 0).when(F.col("z") == 3, 2).otherwise(1))
    harmed = F.when(F.col("z") == 1, "").when(F.col("z") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("z") == 4, "user").otherwise(F.col("role")).alias("role"), harmed.alias("text"), F.explode(times)).drop("col")


@query("op12_turn_repair", SQL)
def op12_turn_repair(spark, sf_dir):
    """One row per conv_id of the table. Null values are one space; conversations of which no row is left have zeros, an empty audit and the hash of nothing."""
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns = R.in_order(damaged(conversations))
    found = R.audits(R.faults(turns))
    hashed = R.digests(R.repaired_turns(turns, found))
    asked = conversations.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid")).distinct()
    joined = asked.join(found, ["known", "cid"], "left").join(hashed, ["known", "cid"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.when(F.col("known"), F.col("cid")).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
