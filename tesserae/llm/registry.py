"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import chat, decontam, langid, lm, minhash, packing, quality, secrets, spelling, structure, suffix, topk, wrapper
from tesserae.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _fold(mod: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


@query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm.score(docs, _fold(5) != 1, order=3)
    return out.select("doc_id", (_fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    logged = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    events = logged.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("target"), "role", "text")
    return chat.read_back(chat.render(chat.reconstruct(events)))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, _fold(4) != 2)
    return langid.predict(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), _fold(3) != 1)
    out = quality.score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return out.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), every=199))


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.addressed(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = secrets.findings(rows, secrets.ledger_in(rows))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select(F.col("path").alias("doc_id"), of("assign"), of("access"), of("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure.repair(structure.damage(turns), turns)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_minhash_dedup"] = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [w] else list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) end) as x from w),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
both_ as (select a, b from links union all select b, a from links),
reach as (select a, b from both_ union select r.a, e.b from reach r join both_ e on r.b = e.a),
low as (select a, min(b) as b from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) as component_id, w.doc_id <= coalesce(low.b, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join low on low.a = w.doc_id"""

ORACLES["op2_pivot_topk"] = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, rank, vec_id, score from r where rank <= 5"""

_ESCAPED = r"regexp_replace(coalesce(text, ''), '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"

ORACLES["op7_chat_format"] = f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) x(t, r)),
f as (select *, length({_ESCAPED}) + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 15 else 20 + length(role) end as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars from f group by conv_id"""

_N, _U, _S = "\ue000", "\ue001", "\ue002"
_NAMED = "regexp_replace(regexp_replace({0}, '([\\p{{L}}\\p{{N}},]\\s)(\\p{{Lu}})', '\\1\ue000\\2', 'g'), '([\\p{{L}}\\p{{N}},]\\s)(\\p{{Lu}})', '\\1\ue000\\2', 'g')"
_MARKED = "regexp_replace(" + _NAMED + ", '(^|[^\\p{{L}}\\p{{M}}\ue000])(\\p{{Lu}})', '\\1\ue002\\2', 'g')"
_DENSE = "".join(f"\\p{{{{{x}}}}}" for x in decontam.SCRIPTS)
_TOKENS = "regexp_extract_all(lower(" + _MARKED + "), '[" + _DENSE + "]\\p{{M}}*|(?:[^\\P{{L}}" + _DENSE + "]|[^\\P{{M}}" + _DENSE + "]|[\ue000\ue002])+|[0-9]+(?:[.,][0-9]+)*')"
_READ = "list_transform(tok, lambda x: replace(x, '\ue002', '')), list_transform(tok, lambda x: translate(x, '\ue000\ue002', '')), list_transform(tok, lambda x: replace(x, '\ue002', '\ue000'))"
_UNITS = ", ".join(f"'{u}'" for u in decontam.UNITS)
_WINDOWS = """{0}_m as (select id, list_transform(tok, lambda x, i: case when x in ({1}) and i > 1 and left(tok[i - 1], 1) between '0' and '9' then '\ue001' || x else x end) as tok from {0}_t),
{0}_w as (select id, size, i - 1 as place, tok[i:i + size - 1] as win from (select id, tok, size, unnest(range(1, len(tok) - size + 2)) as i from {0}_m, {2})),
{0}_s as (select *, list_filter(win, lambda x: left(x, 1) in ('\ue000', '\ue001') or left(x, 1) between '0' and '9') as slots from {0}_w),
{0}_k as (select distinct id, size, place, case when size < {3} or 2 * len(slots) > size then list_transform(win, lambda x: translate(x, '\ue000\ue001', ''))
  else list_transform(win, lambda x: case when left(x, 1) in ('\ue000', '\ue001') then left(x, 1) when left(x, 1) between '0' and '9' then '#' else x end) end as template,
  case when size < {3} or 2 * len(slots) > size then [-1] else list_transform(slots, lambda s: list_position(win, s)) end as pattern from {0}_s)"""

ORACLES["op3_decontaminate"] = (
    "with i_r as (select item_id as id, "
    + ", ".join([_TOKENS.format("text") + " as tok", "list_transform(" + _TOKENS.format("'a ' || text") + "[2:], lambda x: replace(x, '\ue002', '')) as first_"])
    + f" from benchmark where item_id is not null and text is not null),\ni_t as (select distinct id, unnest([{_READ}, first_]) as tok from i_r),\n"
    + _WINDOWS.format("i", _UNITS, f"(select unnest(range({decontam.SHORTEST}, 9)) as size) z where size = least(len(tok), 8)", decontam.LITERAL)
    + ",\nkeys as (select distinct size, template, pattern, id as item_id from i_k), sizes as (select distinct size from keys),\n"
    + f"d_r as (select doc_id as id, {_TOKENS.format('text')} as tok from documents where doc_id is not null and text is not null), d_t as (select distinct id, unnest([{_READ}]) as tok from d_r),\n"
    + _WINDOWS.format("d", _UNITS, "sizes", decontam.LITERAL)
    + ",\nfound as (select distinct d_k.id, item_id, place, size from d_k join keys using (size, template, pattern))\n"
    + "select id as doc_id, item_id, count(*) as n_windows, min(place) as first_token, max(place + size) as last_token from found group by id, item_id"
)

#: Letters of either case, without the further letters that folding case brings in.
_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = "(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SPANS = """select doc_id, {0} as place, '{1}' as kind, cast(upto - length(m) as bigint) as a, cast(upto as bigint) as b, length(g) as size from (select doc_id, m, g,
  sum(length(p) + length(m)) over (partition by doc_id order by k) as upto from (select doc_id, unnest(m) as m, unnest(g) as g, unnest(p[1:len(m)]) as p, generate_subscripts(m, 1) as k from
  (select doc_id, regexp_extract_all(text, '{2}') as m, regexp_extract_all(text, '{2}', {3}) as g, string_split_regex(text, '{2}') as p from d) where len(m) > 0)) where size >= {4}"""
_COUNT_OF = "count(*) filter (kind = '{0}') as n_{0}"

ORACLES["op12_secret_scan"] = (
    "with d as (select doc_id, coalesce(text, '') as text from documents),\nspans as ("
    + " union all ".join(_SPANS.format(i, r.kind, _ASSIGN if r.kind == "assign" else r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES))
    + "),\nf as (select doc_id, "
    + ", ".join(_COUNT_OF.format(k) for k in ("assign", "access", "hex"))
    + ", string_agg(kind || ':' || a || ':' || b, ',' order by a, place) filter (place < 3) as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, place) as spans from spans group by doc_id)\n"
    + "select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join f on d.doc_id = f.doc_id"
)

#: CRC-32 by the rule of its table; letters up to U+00FF are one or two bytes.
_CRC = """crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select cast(unnest(range(256)) as bigint) as i))"""
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: case when ord(x) < 128 then [ord(x)] else [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] end))"
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::bigint, " + _BYTES + "), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)"

ORACLES["op11_spelling_variants"] = (
    f"with recursive {_CRC},\nr as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),\n"
    + "g as (select doc_id, w, count(*) as c from r where length(w) >= 6 group by all),\n"
    + f"h as (select w, c, cast({_CRC_OF.format('doc_id || chr(58) || w')} as bigint) as h from g, crc where doc_id is not null union all select w, c, 1 from g where doc_id is null),\n"
    + "v as (select case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as w, c from h),\n"
    + "words as (select w, cast(sum(c) as bigint) as n from v where length(w) >= 6 group by w having sum(c) >= 5),\n"
    + "gone as (select w, n, i, left(w, i) || substr(w, i + 2) as d from (select w, n, unnest(range(length(w))) as i from words)),\n"
    + "pairs as (select a.w as a, b.w as b from gone a join gone b on a.d = b.d and a.i = b.i and a.w <> b.w union select w, d from gone join words using_ on using_.w = d union select d, gone.w from gone join words using_ on using_.w = d),\n".replace("select w, d from gone join", "select gone.w, d from gone join")
    + "near as (select a, b, x.n as n, y.n as m, row_number() over (partition by a order by y.n desc, b) as k, count(*) over (partition by a) as n_near from pairs join words x on x.w = a join words y on y.w = b),\n"
    + "form as (select a, b, m, n_near, m >= 5 * n as has from near where k = 1),\n"
    + "walk as (select w, w as root, 0 as step from words union all select walk.w, form.b, step + 1 from walk join form on form.a = walk.root where has),\n"
    + "ends as (select w, arg_max(root, step) as root from walk group by w)\n"
    + "select words.w as word, n, coalesce(n_near, 0) as n_near, case when has then b end as form, case when has then m end as form_n, root from words left join form on form.a = words.w join ends on ends.w = words.w"
)

#: The cheapest edits from the back: for each state (nothing yet, after s, u, a) a struct of cost, initials and lines, of which the least is taken.
_WAY = "{{'c': {0}.c + {1}, 'a': '{2}' || {0}.a, 'r': {3} || {0}.r}}"


def _ways(q: str) -> str:
    """What may be done with a row in state ``q``; an insert comes right before the row that is retained after it."""
    up = {"n": "u", "s": "u", "u": "a", "a": "u"}
    role = {"u": "user", "a": "assistant"}

    def retained(state: str, cost: int, initials: str, line: str) -> list[str]:
        next_ = up[state]
        own = [("u" if state in "ns" else next_, next_)] + ([("s", "s")] if state == "n" else [])
        keep = [f"case when i.initial = '{x}' then {_WAY.format('n.' + y, f'{cost} + open', initials + 'K', line + 'i.role || chr(58) || i.text || chr(10)')} end" for x, y in own]
        return [*keep, _WAY.format("n." + next_, f"{cost + 2} + open", initials + "R", line + f"'{role[next_]}:' || i.text || chr(10)")]

    free = [*retained(q, 0, "", ""), *retained(up[q], 2, "I", f"'{role[up[q]]}:' || chr(10) || ")]
    return "list_min(list_filter([" + _WAY.format("n." + q, 3, "D", "''") + ", " + ", ".join(f"case when not gone then {w} end" for w in free) + "], lambda x: x is not null))"


ORACLES["op13_structure_repair"] = (
    f"with recursive {_CRC},\nk as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC_OF.format("coalesce(conv_id::varchar, ' ') || chr(58) || coalesce(turn::varchar, ' ')")} % 20 as k from conversations, crc),\n"
    + "d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy from k where k > 0),\n"
    + "o as (select conv_id, turn, role, text, left(role, 1) as initial, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) not in ('.', '!', '?') as unended from d),\n"
    + "p as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as later, coalesce(lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au'), false) as bad, count(*) over (partition by conv_id) as total from o),\n"
    + "f as (select *, blank or later as gone, cast(unended as bigint) as open from p),\n"
    + "w as (select conv_id, total + 1 as i, {'c': 0::bigint, 'a': '', 'r': ''} as n, {'c': 4::bigint, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)} as s, {'c': 2::bigint, 'a': 'I', 'r': 'assistant:' || chr(10)} as u, {'c': 0::bigint, 'a': '', 'r': ''} as a from f where i = 1\n"
    + "  union all select n.conv_id, i.i, " + ", ".join(_ways(q) for q in "nsua") + " from w n join f i on i.conv_id is not distinct from n.conv_id and i.i = n.i - 1),\n"
    + "c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(not blank and later) as duplicate, count_if(not gone and unended) as truncated, count_if(bad) as illegal from f group by conv_id)\n"
    + "select x.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, " + ", ".join(f"cast(coalesce({y}, 0) as bigint) as {y}" for y in ("blank", "duplicate", "truncated", "illegal")) + ",\n"
    + "  coalesce(w.n.c, 0) as cost, coalesce(w.n.a, '') as audit, sha256(coalesce(w.n.r[:-2], '')) as repaired_sha256\n"
    + "from (select distinct conv_id from conversations) x left join c on c.conv_id is not distinct from x.conv_id left join w on w.conv_id is not distinct from x.conv_id and w.i = 1"
)
