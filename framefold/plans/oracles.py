"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from framefold.functions.hashing import HASH_ALPHABET
from framefold.plans.fixtures import DIM, MAX_IMAGES, NOW, SEED

ORACLES: dict[str, str] = {}


def h(value: str) -> str:
    """Content hash of a text or blob expression."""
    letters = [f"substring('{HASH_ALPHABET}', 1 + (((('0x' || substring(sha256({value}), {start}, 10))::BIGINT) "
               f">> {5 * i}) & 31)::INT, 1)" for start in (1, 11) for i in range(7, -1, -1)]
    return "(" + " || ".join(letters) + ")"


def age(seconds: str) -> str:
    cases = []
    for name, length in (("day", 86400), ("hour", 3600), ("minute", 60)):
        shown = f"cast(round(({seconds}) / {length}.0) as bigint)"
        cases.append(f"when ({seconds}) >= {2 * length} then {shown} || ' {name}s'")
        cases.append(f"when ({seconds}) >= {length} then {shown} || ' {name}'")
    return f"case {' '.join(cases)} else cast(round({seconds}) as bigint) || ' seconds' end"


def size(n: str) -> str:
    return (f"case when {n} < 1024 then {n} || ' b' "
            f"when {n} / 1024.0 < 1024 then printf('%.1f', round(({n})::DOUBLE / 1024, 1)) || ' Kb' "
            f"else printf('%.4f', ({n})::DOUBLE / 1048576) || ' Mb' end")


def dist(a: str, b: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])))"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: (x::DOUBLE / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])))::FLOAT)"


K = "regexp_extract(props, '([0-9]+)', 1)::BIGINT"

CTE = {
    "docs": f"docs as (select *, {h('text')} as hash, octet_length(encode(text)) as bytes from documents)",
    "payloads": "payloads as (select hash, any_value(text) as text, any_value(bytes) as bytes from docs group by hash)",
    "images": f"images as (select {h('vec_id::VARCHAR')} as hash, vec_id, embedding as vector, label from embeddings)",
    "raw": f"""raw as (select event_id, ts, event_type, user_id, {K} as k, event_id % n as x,
        (event_id * 31 + {K}) % n as y from events, (select count(*) as n from embeddings))""",
    "reviews": """reviews as (select event_id, ts, k, a.hash as hash_x, b.hash as hash_y,
        case when event_type = 'purchase' then 'confirm' when event_type = 'error' and k = 7 then 'delete_left'
             when event_type = 'error' and k = 8 then 'delete_right' when event_type = 'signup' then 'orient'
             when event_type = 'view' then 'offer' end as action
        from raw join images a on a.vec_id = x join images b on b.vec_id = y)""",
    "edges": """edges as (select hash, peer, max(ts) as ts from (
            select hash_x as hash, hash_y as peer, ts from reviews where action = 'confirm'
            union all select hash_y, hash_x, ts from reviews where action = 'confirm') where hash <> peer
        group by hash, peer)""",
    "catalog": """catalog as (select i.hash, 0 as rotatemode, 0 as flipmode,
            coalesce(f.lastview, (select min(ts) from events)
                - to_minutes(('0x' || substring(md5(i.hash), 1, 3))::BIGINT)) as lastview,
            coalesce(f.hist_len, 0) as hist_len, i.vector, i.label, i.vec_id
        from images i left join (select hash, max(ts) as lastview, count(*) as hist_len from edges group by hash) f
            on f.hash = i.hash)""",
    "gone": """gone as (select hash, min(ts) as deleted_at from (
            select hash_x as hash, ts from reviews where action = 'delete_left'
            union all select hash_y, ts from reviews where action = 'delete_right') group by hash)""",
    "tenth": """tenth as (select * from (select *, row_number() over (order by lastview, hash) as rn from catalog)
        where rn <= (select count(*) // 10 from catalog))""",
    "picks": f"""picks as (select hist_len, hash from (select hist_len, hash,
            row_number() over (partition by hist_len order by md5(hash || '{SEED}'), hash) as rn2 from tenth)
        where rn2 = 1)""",
    "near": f"""near as (select hash, peer, d from (select a.hash, b.hash as peer,
            round({dist('a.vector', 'b.vector')}, 6) as d,
            row_number() over (partition by a.hash order by round({dist('a.vector', 'b.vector')}, 6), b.hash) as rn3
        from images a join images b on a.hash <> b.hash) where rn3 = 1)""",
    "orient": """orient as (select hash_x as hash, arg_max(((k % 4) * 90)::INT, (ts, event_id)) as rotatemode,
            arg_max((k % 3)::INT, (ts, event_id)) as flipmode
        from reviews where action = 'orient' group by hash_x)""",
    "known": """known as (select hash, max(toxic) = 0 as chunk_ok from docs join labels using (doc_id)
        where quality = 1 group by hash)""",
    "files": """files as (select doc_id, hash as content,
            'raw/' || doc_id || '/' || (case when lang = 'en' then hash else 'doc-' || doc_id end) || '.txt' as path,
            lang = 'en' as named, bytes >= 16 as readable, bytes > 16 as durable, trim(text, ' ') <> '' as decodable
        from docs)""",
    # Files here are named after their own content or not after any, so an earlier copy decides alone.
    "judged": """judged as (select f.*, k.hash is not null as old, coalesce(k.chunk_ok, false) as chunk_ok,
            f.readable and f.decodable and k.hash is null as candidate,
            row_number() over (partition by f.content, f.readable and f.decodable and k.hash is null
                               order by f.doc_id) as copy,
            min(f.doc_id) filter (f.durable and named) over (partition by f.content) as heals
        from files f left join known k on k.hash = f.content)""",
    "outcomes": """outcomes as (select *,
            case when named and old and (chunk_ok or doc_id > coalesce(heals, 9e18)) then 'found'
                 when named and old and not readable then 'bad'
                 when named and old then 'found'
                 when not readable then 'bad'
                 when old then 'found'
                 when not decodable then 'bad'
                 when copy = 1 then 'added' else 'found' end as outcome
        from judged)""",
    "clocked": """clocked as (select *, coalesce(sum((outcome = 'added')::INT) over (order by doc_id
            rows between unbounded preceding and 1 preceding), 0) as before from outcomes)""",
}

NEEDS = {
    "payloads": ["docs"], "reviews": ["images", "raw"], "edges": ["reviews"], "catalog": ["edges"],
    "gone": ["reviews"], "tenth": ["catalog"], "picks": ["tenth"], "near": ["images"], "orient": ["reviews"],
    "known": ["docs"], "files": ["docs"], "judged": ["files", "known"], "outcomes": ["judged"],
    "clocked": ["outcomes"],
}


def sql(name: str, needs: str, body: str) -> None:
    order: list[str] = []

    def add(cte: str) -> None:
        for below in NEEDS.get(cte, []):
            add(below)
        if cte not in order:
            order.append(cte)

    for cte in needs.split():
        add(cte)
    prefix = "with " + ",\n".join(CTE[c] for c in order) + "\n" if order else ""
    ORACLES[name] = prefix + body


# ---------------------------------------------------------------- scalar functions
sql("content_hash", "docs", "select doc_id, hash from docs")
sql("content_dedup", "docs", "select hash, min(doc_id) as first_doc, count(*) as copies from docs group by hash")
sql("valid_hash", "docs", f"""select doc_id, form, length(v) = 16 and translate(v, '{HASH_ALPHABET}', '') = '' as valid
from (select doc_id, unnest(['hash', 'upper', 'longer', 'newline', 'letter', 'md5']) as form,
    unnest([hash, upper(hash), hash || '0', hash[1:15] || chr(10), hash[1:15] || 'o', md5(text)[1:16]]) as v from docs)""")
sql("file_type", "docs", """select doc_id,
    case doc_id % 9 when 1 then 'jpg' when 2 then 'png' when 3 then 'gif' when 4 then 'bmp' when 5 then 'tiff'
        when 6 then 'tiff' when 7 then 'webp' when 8 then 'mp4' else 'xxx' end as ext,
    doc_id % 9 = 8 as video, bytes + extra >= 16 as readable, bytes + extra > 16 as durable
from (select *, [0, 3, 4, 4, 2, 4, 4, 12, 8][1 + doc_id % 9] as extra from docs)""")
sql("history_parse", "docs", f"""select doc_id, array_to_string(p, '') as history, len(p) as peers, 4 as written
from (select doc_id, list_sort(list_distinct([hash, {h('source')}, {h('lang')}])) as p from docs)""")
sql("history_insert", "docs", f"""select doc_id,
    array_to_string(list_sort(list_distinct([hash, {h('source')}, {h('lang')}])), '') as history from docs""")
sql("bad_history", "docs", """select doc_id as hash, length(t) as length, length(t) % 16 <> 0 as ragged
from (select doc_id, case lang when 'en' then hash || 'x' when 'de' then replace(hash, '0', 'o') else hash end as t
      from docs) where length(t) % 16 <> 0 or contains(t, 'o')""")
sql("age_text", "", f"select event_id, {age('value * value * value')} as age from events")
sql("size_text", "", f"select doc_id, {size('n_chars')} as size, {size('(n_chars * n_chars)')} as square from documents")
sql("distance_key", "images", f"""select i.hash, lpad(least(9999, greatest(0,
    round_even((({dist('i.vector', 'b.vector')})::FLOAT * 10000::FLOAT)::DOUBLE, 0)::INT))::VARCHAR, 4, '0') || i.hash as distance_key
from images i, images b where b.vec_id = 0""")
sql("capture_date", "", """select event_id, case event_type when 'error' then date_trunc('second', ts)
    when 'purchase' then least(date_trunc('second', ts), timestamp '2023-12-31 00:00:00')
    else date_trunc('second', ts) end as taken from events""")
sql("dated_name", "", f"""select event_id, strftime(ts, '%Y-%m-%d/%H%M%S.') || {h('event_id::VARCHAR')}
    || case when {K} % 3 > 0 then '(' || {K} % 3 || ')' else '' end
    || case when event_type = 'error' then '' else '.' || event_type end as name from events""")
sql("recycled_hash", "", f"""select event_id, case when event_type = 'error' or event_id % 10000000 > 999999 then ''
    else upper({h('event_id::VARCHAR')}) end as hash from events""")
sql("model_size", "", """select doc_id, sw as scaled_w, sh as scaled_h, least(1024, sw - sw % 16) as crop_w,
    least(1024, sh - sh % 16) as crop_h
from (select doc_id, round_even((w * s)::DOUBLE, 0)::INT as sw, round_even((hh * s)::DOUBLE, 0)::INT as sh
    from (select *, 384::FLOAT / least(w, hh) as s
        from (select doc_id, (n_chars + 16)::FLOAT as w, (doc_id * 37 % 3000 + 16)::FLOAT as hh from documents)))""")
sql("ticks", "", "select event_id, epoch_us(ts) * 10 + 621355968000000000 as ticks, ts as back from events")
sql("meta_summary", "", f"""select event_id, substring(concat_ws(' ', case when event_type <> 'error' then 'E:' || {K} end,
    case when event_type = 'view' then 'P:' || user_id end,
    case when event_type <> 'click' then 'C:' || event_id * 1000000007 end,
    case when event_type <> 'signup' then 'X:' || event_id * 1000003 end), 1, 30) as meta from events""")
sql("fit_and_normalize", "images", f"""select hash, 16 as size_16, 80 as size_80,
    round(sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])), 4) as norm_16, round(a[1]::DOUBLE, 4) as first_16,
    round(a[16]::DOUBLE, 4) as last_16, round(sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])), 4) as norm_80,
    round(b[1]::DOUBLE, 4) as first_80, 0.0::DOUBLE as last_80
from (select hash, {unit('vector[1:16]')} as a, {unit('vector')} as b from images)""")
sql("vector_bytes", "images", "select hash, len(vector) * 4 as bytes, true as same from images")

# ---------------------------------------------------------------- scans and lookups
WEIGHTED = "round(list_dot_product({0}::DOUBLE[], list_transform(range(1, len({0}) + 1), lambda i: i::DOUBLE)), 4)"
sql("load_vectors", "images", f"select hash, len(vector) as dim, {WEIGHTED.format('vector')} as weighted from images")
sql("all_hashes", "images", "select hash from images")
sql("point_lookup", "catalog", "select hash, rotatemode, flipmode, lastview, hist_len from catalog where vec_id = 7")
ASKED = f"(select distinct {h('(user_id * 7)::VARCHAR')} as hash from events)"
sql("vectors_of", "images", f"""select a.hash, coalesce(len(i.vector), 0) as dim,
    coalesce({WEIGHTED.format('i.vector')}, 0.0) as weighted
from {ASKED} a left join images i on i.hash = a.hash""")
sql("contains", "images", f"select a.hash, a.hash in (select hash from images) as known from {ASKED} a")
sql("lookup_many", "images", f"select hash, label from images where hash in (select hash from {ASKED})")
sql("needs_vector", "images", "select hash, label from images where label in (3, 4, 5)")
sql("bad_vectors", "images", "select hash, case label when 4 then 10 else 0 end as size from images where label in (4, 5)")

# ---------------------------------------------------------------- counts and status
sql("image_count", "", "select count(*) as images from embeddings")
sql("oldest_view", "catalog", """select min(lastview) as lastview, min(lastview) - interval 1 second as before
from catalog""")
sql("min_history", "catalog", "select min(hist_len) as min_history from catalog")
LEAST = "(select count(*) from catalog where hist_len = (select min(hist_len) from catalog))"
sql("min_history_count", "catalog", f"select {LEAST} as images")
COUNTS = f"{LEAST} || '/' || (select count(*) from catalog) || ' (' || ((select count(*) from catalog) - {MAX_IMAGES}) || ')'"
sql("status", "catalog", f"select {COUNTS} as status")
sql("capacity", "", f"""select count(*) as images, {MAX_IMAGES + 10000}::BIGINT as capacity,
    count(*) > {MAX_IMAGES + 10000} as over from embeddings""")

# ---------------------------------------------------------------- sampler
HEAD = f"(select hash from picks order by md5(hash || '{SEED}outer'), hash limit 1)"
SCORED = "(select hash from catalog order by hist_len, lastview, hash limit 1)"
PAIRED = "(select hash from near order by d, hash limit 1)"
sql("oldest_tenth", "tenth", "select hash, lastview from tenth")
sql("stratum_picks", "picks", "select hist_len, hash from picks")
sql("queue_head", "picks", f"select hash from {HEAD}")
sql("stalest_checked", "catalog", """select hash, lastview - to_minutes(hist_len * 600) as lastcheck from catalog
order by 2, 1 limit 1""")
sql("least_scored", "catalog", "select hash, hist_len as score, lastview from catalog order by 2, 3, 1 limit 1")
sql("closest_pair", "near", "select hash, d as distance from near order by d, hash limit 1")
sql("mixed_pick", "catalog near", f"""select seed, draw,
    case when draw < 80 then {SCORED} else {PAIRED} end as hash
from (select seed, ('0x' || substring(md5(seed), 1, 8))::BIGINT % 100 as draw
      from (values ('lamp'), ('a')) t(seed))""")
AFTER = f"""after as (select hash, peer, d from (select g.hash, b.hash as peer, round({dist('a.vector', 'b.vector')}, 6) as d,
    row_number() over (partition by g.hash order by round({dist('a.vector', 'b.vector')}, 6), b.hash) as rn4
    from gone g join images a on a.hash = g.hash join images b on b.hash not in (select hash from gone)) where rn4 = 1)"""
CTE["after"], NEEDS["after"] = AFTER, ["gone"]
sql("next_x", "picks after", f"""select 'draw' as policy, hash from {HEAD}
union all select 'same', hash from {SCORED}
union all select distinct 'deleted', peer from after""")

# ---------------------------------------------------------------- neighbours
sql("beam", "images", f"""select i.hash, round({dist('i.vector', 'b.vector')}, 6) as distance
from images i, images b where b.vec_id = 0""")
sql("closest", "images", f"""select hash, round(d, 4) as distance from (select i.hash,
    round({dist('i.vector', 'list_transform(b.vector, lambda x: -x)')}, 6) as d
from images i, images b where b.vec_id = 1) order by d, hash limit 1""")
sql("base_vs_many", "images", f"""select 'base-' || i.label || '_' || i.hash || ' = '
    || printf('%.4f', {dist('i.vector', 'b.vector')}) as label from images i, images b where b.vec_id = 2""")
sql("distance_summary", "images", f"""select round(min(d), 6) as min_distance, round(max(d), 6) as max_distance,
    round(avg(d), 6) as avg_distance, count(d) as compared, count(*) - count(d) as skipped
from (select case when i.label in (3, 4, 5) then null else
    {dist('i.vector', 'b.vector')} end as d from images i, images b where b.vec_id = 0)""")
sql("separation", "images", f"""select setting, round(s, 4) as sim_avg, round(o, 4) as nosim_avg, round(o - s, 4) as separation
from (select setting, avg(d) filter (same) as s, avg(d) filter (not same) as o from (
    select setting, i.label = b.label as same, {dist(unit('i.vector[1:setting]'), unit('b.vector[1:setting]'))} as d
    from images i, images b, (values (16), (32), (48), (64)) t(setting) where b.vec_id = 0 and i.vec_id <> 0)
    group by setting)""")
sql("nearest_neighbors", "near", "select hash, peer, d as distance from near")
sql("neighbor_drift", "near", f"""select n.hash, n.peer, abs(n.d - o.d) >= 1e-4 as moved,
    case when abs(n.d - o.d) >= 1e-4 then printf('%.4f', round(o.d, 4)) || ' → ' else '' end || printf('%.4f', round(n.d, 4)) as message
from near n join (select a.hash, min(round({dist('a.v', 'b.v')}, 6)) as d
    from (select hash, {unit('vector[1:48]')} as v from images) a
    join (select hash, {unit('vector[1:48]')} as v from images) b on a.hash <> b.hash group by a.hash) o
on o.hash = n.hash""")
PARTNERS = f"""select hash_x, hash_y, d from (select q.hash as hash_x, c.hash as hash_y, round({dist('q.vector', 'c.vector')}, 6) as d,
    row_number() over (partition by q.hash order by round({dist('q.vector', 'c.vector')}, 6), c.hash) as rn5
    from (%s) q join (%s) c on c.hist_len = q.hist_len and c.hash <> q.hash
    left join edges e on e.hash = q.hash and e.peer = c.hash where e.hash is null) where rn5 = 1"""
sql("review_partner", "catalog", f"""select c.hash as hash_x, p.hash_y, p.d as distance
from catalog c left join ({PARTNERS % ('from catalog', 'from catalog')}) p on p.hash_x = c.hash""")
sql("unseen_pairs", "edges", """select distinct hash_x as hash, hash_y as peer from reviews r
where action = 'offer' and hash_x <> hash_y
    and not exists (select 1 from edges e where e.hash = r.hash_x and e.peer = r.hash_y)""")
sql("closest_to_deleted", "after", "select hash, peer, d as distance from after")
ALIVE = "from catalog where hash not in (select hash from gone)"
sql("partners_after_delete", "catalog after", f"""select a.hash as deleted, a.peer as hash_x, p.hash_y,
    p.d as distance from after a left join ({PARTNERS % (ALIVE, ALIVE)}) p on p.hash_x = a.peer""")

# ---------------------------------------------------------------- consistency
sql("differences", "images", """select hash, case label when 7 then 'left' else 'right' end as side
from images where label in (2, 7)""")
sql("reconcile", "images", """select side, count(m.hash) as missing,
    coalesce((select string_agg(hash, ' ' order by hash) from (select hash from images i where i.label = any_value(t.label)
              order by hash limit 5)), '') as sample
from (values ('left', 7), ('right', 2)) t(side, label) left join images m on m.label = t.label group by side""")
sql("dangling_history", "edges", """select e.hash, e.peer from edges e join images i on i.hash = e.peer
where i.label = 5""")
sql("asymmetric_history", "edges", """select e.hash, e.peer from edges e join images i on i.hash = e.peer
join images own on own.hash = e.hash
where i.label = 3 and e.peer < e.hash and not (own.label = 3 and e.hash < e.peer)""")

# ---------------------------------------------------------------- reviews and snapshots
sql("review_fold", "edges", "select hash, max(ts) as lastview, count(*) as hist_len from edges group by hash")
sql("history_text", "edges", "select hash, string_agg(peer, '' order by peer) as history from edges group by hash")
sql("stored_rows", "catalog", f"""select c.hash, rotatemode, flipmode, epoch_us(lastview) * 10 + 621355968000000000 as lastview,
    coalesce(history, '') as history, {DIM * 4} as vector_bytes
from catalog c left join (select hash, string_agg(peer, '' order by peer) as history from edges group by hash) e
on e.hash = c.hash""")
sql("stored_rows_read_back", "catalog", f"select hash, lastview, hist_len, {DIM} as dim from catalog")
sql("merged_edges", "edges", "select hash, peer from edges")
sql("tombstones", "gone", "select hash, deleted_at from gone")
VIEWS = """(select hash, max(ts) as lastview from (
    select hash_y as hash, ts from reviews where action = 'delete_left'
    union all select hash_x, ts from reviews where action = 'delete_right') group by hash)"""
sql("survivor_views", "reviews", f"select hash, lastview from {VIEWS}")
sql("orientations", "orient", "select hash, rotatemode, flipmode from orient")
sql("apply_events", "edges gone orient", f"""select i.hash, coalesce(o.rotatemode, 0) as rotatemode,
    coalesce(o.flipmode, 0) as flipmode,
    coalesce(greatest(e.lastview, v.lastview), timestamp '2023-12-01 00:00:00') as lastview,
    coalesce(e.hist_len, 0) as hist_len
from images i left join orient o on o.hash = i.hash
left join (select hash, max(ts) as lastview, count(*) as hist_len from edges group by hash) e on e.hash = i.hash
left join {VIEWS} v on v.hash = i.hash where i.hash not in (select hash from gone)""")
sql("apply_events_edges", "edges gone", "select hash, peer from edges where hash not in (select hash from gone)")
sql("snapshot_insert", "catalog", """select hash, rotatemode, flipmode,
    case when label = 1 then timestamp '2023-12-01 00:00:00' else lastview end as lastview,
    case when label = 1 then 0 else hist_len end as hist_len from catalog""")
sql("snapshot_update", "catalog orient", """select c.hash, coalesce(o.rotatemode, 0) as rotatemode,
    coalesce(o.flipmode, 0) as flipmode, c.lastview, c.hist_len from catalog c left join orient o on o.hash = c.hash""")
sql("snapshot_delete", "gone", "select hash, label from images where hash not in (select hash from gone)")
CTE["usable"], NEEDS["usable"] = "usable as (select * from catalog where label <> 6)", ["catalog"]
SECONDS = f"(epoch_us(timestamp '{NOW}') - epoch_us(lastview)) / 1000000.0"
step_tenth = CTE["tenth"].replace("from catalog", "from usable")
CTE["usable_tenth"], NEEDS["usable_tenth"] = step_tenth.replace("tenth as", "usable_tenth as", 1), ["usable"]
CTE["usable_picks"] = CTE["picks"].replace("picks as", "usable_picks as", 1).replace("from tenth", "from usable_tenth")
NEEDS["usable_picks"] = ["usable_tenth"]
sql("review_step", "usable_picks", f"""select u.hash as hash_x, p.hash_y, p.d as distance,
    {COUNTS.replace('catalog', 'usable')} || ' [' || {age(SECONDS)} || ' ago]' || coalesce(' ' || printf('%.4f', round(p.d, 4)), '') as status
from usable u left join ({PARTNERS % ('from usable', 'from usable')}) p on p.hash_x = u.hash
where u.hash = {HEAD.replace('picks', 'usable_picks')}""")
sql("unreadable_images", "images", "select hash from images where label = 6")
sql("catalog_card", "catalog docs", f"""select c.hash, substring(c.hash, 1, 4) || '.'
    || case doc_id % 9 when 1 then 'jpg' when 2 then 'png' when 3 then 'gif' when 4 then 'bmp' when 5 then 'tiff'
        when 6 then 'tiff' when 7 then 'webp' when 8 then 'mp4' else 'xxx' end
    || case when hist_len > 0 then ' [' || hist_len || ']' else '' end || chr(10)
    || {size('(bytes + [0, 3, 4, 4, 2, 4, 4, 12, 8][1 + doc_id % 9])')} || '  (640x' || (label + 480) || ')' || chr(10)
    || ' ' || {age(SECONDS)} || ' ago ' || case when label < 5 then ' [' || strftime(lastview, '%Y-%m-%d') || ']' else '' end
    || ' E:' || label || ' X:' || (bytes + [0, 3, 4, 4, 2, 4, 4, 12, 8][1 + doc_id % 9]) as label
from catalog c join docs d on d.doc_id % (select count(*) from images) = c.vec_id""")

# ---------------------------------------------------------------- import
sql("ingest_outcomes", "outcomes", """select path, outcome,
    named and old and not chunk_ok and readable and doc_id <= coalesce(heals, 9e18) as writes from outcomes""")
SUMS = ", ".join(f"count(*) filter (outcome = '{o}') as {o}" for o in ("added", "found", "bad"))
sql("ingest_counts", "outcomes", f"select {SUMS} from outcomes")
sql("ingest_added", "clocked", """select content as hash, path, 0 as rotatemode, 0 as flipmode,
    (select min(ts) from events) - to_minutes(before::BIGINT) as lastview, 0::BIGINT as hist_len
from clocked where outcome = 'added'""")
REPAIRED = """select content as hash, arg_max(path, doc_id) as path, arg_max(doc_id, doc_id) as doc_id from clocked
    where named and old and not chunk_ok and readable and doc_id <= coalesce(heals, 9e18) group by content"""
STORED = f"(select content as hash, path, doc_id from clocked where outcome = 'added' union all {REPAIRED})"
sql("ingest_chunks", "clocked", f"select hash, path from {STORED}")
sql("ingest_log", "clocked", """select path, outcome,
    case when readable or (named and old) then content end as hash from clocked""")
sql("ingest_summary", "clocked", f"select {SUMS}, {MAX_IMAGES - 100}::BIGINT as max_images from clocked")
sql("ingest_payloads", "clocked", f"""select s.hash, sha256(d.text) as sha256, d.bytes
from {STORED} s join docs d on d.doc_id = s.doc_id""")

# ---------------------------------------------------------------- chunk store
sql("chunk_roundtrip", "payloads", """select hash, bytes + 28 as chunk_bytes, sha256(text) as sha256, true as locked
from payloads""")
sql("chunk_audit", "payloads", """select case when bytes <= 16 then 'lost' when hash[1] > '3' then 'ok'
    when hash[1] < '2' then 'healable' else 'lost' end as status, count(*) as chunks from payloads group by 1""")
sql("verified_read", "payloads", """select hash, case when not ok then 'lost' when hash[1] > '3' then 'ok' else 'healable' end
    as status, ok and hash[1] <= '3' as healed, case when ok then sha256(text) end as sha256
from (select *, bytes > 16 and (hash[1] > '3' or hash[1] < '2') as ok from payloads)""")
sql("chunk_path", "payloads", """select hash, 'chunks/' || hash[1] || '/' || hash[2] || '/' || hash || '.mex' as path
from payloads""")
sql("read_payloads", "docs", """select doc_id, case when lang = 'fr' then '120000.' || hash else hash end as stem,
    case when bytes >= 16 and lang in ('en', 'de', 'fr') then sha256(text) end as sha256 from docs""")
sql("soft_delete", "payloads known", """select case when k.hash is null then p.hash
        else strftime((select min(ts) from events), '%Y-%m-%d/%H%M%S.') || p.hash || '.xxx' end as name,
    case when k.hash is null then 'kept' else 'recycled' end as state
from payloads p left join known k on k.hash = p.hash and not k.chunk_ok""")
sql("export_plan", "payloads known", f"""select p.hash, strftime(timestamp '{NOW}', '%Y-%m-%d/%H%M%S.') || p.hash || '.xxx' as name,
    p.bytes from payloads p join known k on k.hash = p.hash""")
sql("legacy_roundtrip", "payloads", """select hash, (bytes // 16 + 1) * 16 as sealed_bytes, sha256(text) as sha256
from payloads""")
TURN = "('0x' || substring(md5(hash), 1, 4))::BIGINT"
sql("ingest_capped", "clocked", "select path, outcome from clocked where before < 100")


def byte(place: str) -> str:
    """A byte of the payload as a number; the payload is zero-padded."""
    return f"coalesce(('0x' || nullif(hex(body[({place} + 1):({place} + 1)]), ''))::INT, 0)"


def old(y: str, x: str) -> str:
    """Place of a pixel before flip and turn."""
    row = f"case r when 0 then {y} when 1 then n - 1 - {x} when 2 then n - 1 - {y} else {x} end"
    column = f"case r when 0 then {x} when 1 then {y} when 2 then n - 1 - {x} else n - 1 - {y} end"
    return (f"3 * ((case flip when 2 then n - 1 - ({row}) else {row} end) * n"
            f" + (case flip when 1 then n - 1 - ({column}) else {column} end))")


CTE["squares"], NEEDS["squares"] = f"""squares as (select hash, encode(text) as body, greatest(1, ceil(sqrt(bytes / 3.0)))::BIGINT as n,
    {TURN} % 4 as r, {TURN} % 3 as flip from payloads)""", ["payloads"]
CHANNELS = [("2", "0.485", "0.229"), ("1", "0.456", "0.224"), ("0", "0.406", "0.225")]  # place in the pixel, mean, deviation


def top_row(name: str, turned: bool) -> str:
    """Unit vectors of the channel means of the top row, in the model's single precision."""
    r, flip = ("r", "flip") if turned else ("0", "0")
    means = ", ".join(f"(sum((({byte(f'p + {at}')}::FLOAT / 255::FLOAT - {mean}::FLOAT) / {dev}::FLOAT)::DOUBLE) / n)::FLOAT as m{i}"
                      for i, (at, mean, dev) in enumerate(CHANNELS))
    length = "sqrt(m0::DOUBLE * m0 + m1::DOUBLE * m1 + m2::DOUBLE * m2)"
    units = ", ".join(f"(m{i}::DOUBLE / {length})::FLOAT as u{i}" for i in range(3))
    return f"""{name} as (select hash, {units} from (select hash, {means}
    from (select hash, body, n, {old('0', 'x')} as p from (select hash, body, n, {r} as r, {flip} as flip, unnest(range(n)) as x from squares))
    group by hash, n))"""


CTE["plain"], NEEDS["plain"] = top_row("plain", False), ["squares"]
CTE["turned"], NEEDS["turned"] = top_row("turned", True), ["squares"]
SHOWN = f"{DIM} as dim, " + ", ".join(f"round(u{i}::DOUBLE, 4) as v{i}" for i in range(3)) + ", 0.0::DOUBLE as v3"
MODES = f"({TURN} % 4 * 90)::INT as rotatemode, ({TURN} % 3)::INT as flipmode"
sql("embed_images", "plain", f"select hash, {SHOWN} from plain")
sql("reorient", "turned", f"select hash, {MODES}, {SHOWN} from turned")
# A picture whose modes stay 0 keeps its vector, which is NULL for hashes from a on.
sql("apply_orientations", "turned", f"""select hash, {MODES}, case when stays then null else dim end as dim, case when stays then null else v0 end as v0,
    case when stays then null else v1 end as v1, case when stays then null else v2 end as v2, case when stays then null else v3 end as v3
from (select hash, {TURN} % 4 = 0 and {TURN} % 3 = 0 and hash >= 'a' as stays, {SHOWN} from turned)""")
sql("backfill", "plain turned", f"""select hash, {SHOWN} from turned where hash < 'a'
union all select hash, {SHOWN} from plain where hash >= 'a'""")
sql("vector_drift", "plain turned", f"""select t.hash, case when t.hash < 'a' then round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    1 - (t.u0::DOUBLE * p.u0 + t.u1::DOUBLE * p.u1 + t.u2::DOUBLE * p.u2))), 6) end as distance
from turned t join plain p on p.hash = t.hash order by md5(t.hash || '{SEED}'), t.hash limit 10""")
sql("orient_pixels", "squares", f"""select hash, n::INT as height, n::INT as width, sha256(unhex(string_agg(px, '' order by y, x))) as sha256
from (select hash, n, y, x, rpad(hex(body[(p + 1):(p + 3)]), 6, '0') as px
    from (select hash, n, body, y, x, {old('y', 'x')} as p
        from (select hash, n, body, r, flip, y, unnest(range(n)) as x from (select *, unnest(range(n)) as y from squares))))
group by hash, n""")
GAP = " + ".join(f"power({byte(f'a + {i}')} - {byte(f'b + {i}')}, 2)" for i in range(3))
DIMMED = " || ".join(f"printf('%02X', {byte(f'a + {i}')} // 5)" for i in range(3))
sql("pixel_difference", "squares", f"""select hash as hash_x, hash || 'm' as hash_y, round(avg(moved::INT), 6) as changed, n::INT as height, n::INT as width,
    sha256(unhex(string_agg(case when moved then 'FFFFFF' else dimmed end, '' order by y, x))) as sha256
from (select hash, n, y, x, {GAP} >= 2500 as moved, {DIMMED} as dimmed
    from (select hash, n, body, y, x, 3 * (y * n + x) as a, 3 * (y * n + n - 1 - x) as b
        from (select *, unnest(range(n)) as x from (select *, unnest(range(n)) as y from squares))))
group by hash, n""")

# ---------------------------------------------------------------- files
sql("scan_files", "docs", """select row_number() over (order by contains(name, '/'), case when contains(name, '/') then split_part(name, '/', 1) else '' end, name) - 1 as position,
    name, bytes as size, sha256(text) as sha256
from (select *, case when lang = 'en' then '' else lang || '/' || source || '/' end || ['', '.', '_', 'raw'][1 + doc_id % 4] || doc_id || '.TXT' as name
      from docs where doc_id % 10 <> 9 and bytes >= 16)""")
sql("export_files", "payloads known", f"""select strftime(timestamp '{NOW}', '%Y-%m-%d/%H%M%S.') || p.hash || '.xxx' as name, p.bytes as size, sha256(p.text) as sha256
from payloads p join known k on k.hash = p.hash""")
sql("decode_images", "payloads", """select hash, hash[1] <> '0' as decodable, case when hash[1] <> '0' then side end as height, case when hash[1] <> '0' then side end as width,
    case when hash[1] <> '0' then sha256(text || repeat(chr(0), side * side * 3 - bytes)) end as sha256
from (select *, (4 * greatest(1, ceil(sqrt(bytes / 3.0) / 4)))::INT as side from payloads)""")
sql("import_commit", "clocked plain", f"""select path, outcome, case when readable or (named and old) then content end as hash,
    case when outcome = 'added' then case when durable then 'ok' else 'lost' end end as chunk, dim, v0, v1, v2, v3
from clocked left join (select hash, {SHOWN} from plain) v on v.hash = content and outcome = 'added'""")
