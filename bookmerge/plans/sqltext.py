"""SQL text of the scalar functions, for engines that check results; x is an SQL expression."""

from __future__ import annotations

from bookmerge.functions.name_families import FAMILIES
from bookmerge.functions.names import PARTICLES
from bookmerge.functions.normalize import LEGAL_FORMS
from bookmerge.plans.fixtures import BOOK_LEFT, BOOK_RIGHT, MAPPING

EDGES = r"^[\p{Z}\s]+|[\p{Z}\s]+$"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '{EDGES}', '', 'g')"


def non_blank(x: str) -> str:
    return f"nullif({trim(x)}, '')"


def name(x: str) -> str:
    words = rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '\p{{P}}', '', 'g'), '[\p{{Z}}\s]+'), lambda w: w <> '')"
    return f"(select array_to_string(case when len(ws) > 2 then list_filter(ws, lambda w: length(w) > 1) else ws end, ' ') from (select {words} as ws))"


def full_name(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(name(p) for p in parts)}], lambda p: p <> ''), ' ')"


def email(x: str) -> str:
    e = trim(f"lower(coalesce({x}, ''))")
    return f"(select case when contains(e, '@gmail.com') or contains(e, '@googlemail.com') then replace(split_part(e, '@', 1), '.', '') || substr(e, strpos(e, '@')) else e end from (select {e} as e))"


def digits(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[^\p{{N}}]', '', 'g')"


def phone(x: str) -> str:
    return rf"case when {digits(x)} = '' then '' when regexp_matches({x}, '^[^\p{{N}}]*\+') then '+' || {digits(x)} else {digits(x)} end"


def organization(x: str) -> str:
    forms = "|".join(f.replace(".", r"\.") for f in sorted(LEGAL_FORMS, key=len, reverse=True))
    return trim(f"regexp_replace({trim(f'lower(coalesce({x}, {chr(39) * 2}))')}, ' (?:{forms})$', '')")


def url(x: str) -> str:
    u = trim(f"lower(coalesce({x}, ''))")
    for pattern in ("/+$", "^https://", "^http://", r"^www\."):
        u = f"regexp_replace({u}, '{pattern}', '')"
    return u


def address(street: str, city: str) -> str:
    return f"array_to_string(list_filter([{trim(f'lower(coalesce({street}, {chr(39) * 2}))')}, {trim(f'lower(coalesce({city}, {chr(39) * 2}))')}], lambda p: p <> ''), ' ')"


def birthday(y: str, m: str, d: str) -> str:
    return f"case when {m} is not null and {d} is not null then concat(case when {y} is null or {y} in (0, 1604) then '-' else cast({y} as varchar) end, '-', {m}, '-', {d}) end"


def display(c: str = "") -> str:
    parts = ", ".join(non_blank(f"{c}{f}") for f in ("given_name", "middle_name", "family_name"))
    return f"coalesce(nullif(array_to_string(list_filter([{parts}], lambda p: p is not null), ' '), ''), {non_blank(c + 'email')}, {non_blank(c + 'phone')}, {non_blank(c + 'organization_name')}, {non_blank(c + 'nickname')}, 'Unnamed contact')"


def soundex(x: str) -> str:
    """Run collapse by list functions: this engine's expressions have no back-references."""
    letters = rf"upper(regexp_replace(coalesce({x}, ''), '[^\p{{L}}]', '', 'g'))"
    codes = f"regexp_replace(translate({letters}, 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '[^1-6]', '0', 'g')"
    kept = "list_filter(range(1, length(c) + 1), lambda i: i > 1 and c[i] <> c[i - 1] and c[i] <> '0')"
    return f"(select case when l = '' then '' else substr(rpad(l[1] || array_to_string(list_transform({kept}, lambda i: c[i]), ''), 4, '0'), 1, 4) end from (select {letters} as l, {codes} as c))"


def nickname(normalized: str) -> str:
    number = {n: i for i, line in enumerate(FAMILIES.strip().splitlines()) for n in line.split()}
    return f"[{', '.join(map(str, number.values()))}][list_position([{', '.join(f'{chr(39)}{n}{chr(39)}' for n in number)}], split_part({normalized}, ' ', 1))]"


def title(x: str) -> str:
    particles = ", ".join(f"'{p}'" for p in PARTICLES)
    up = lambda v: f"upper({v}[1]) || substr({v}, 2)"
    seg = f"case when i > 1 and s in ({particles}) then s when regexp_matches(s, '^[od]''.') then upper(s[1]) || '''' || {up('substr(s, 3)')} when starts_with(s, 'mc') and length(s) > 2 then 'Mc' || {up('substr(s, 3)')} when starts_with(s, 'mac') and length(s) > 4 then 'Mac' || {up('substr(s, 4)')} else {up('s')} end"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w, i: array_to_string(list_transform(string_split(lower(w), '-'), lambda s: {seg}), '-')), ' ')"


#: Both books and the mapping, with normalised columns: f full name, sim, g, n, e, p, o, a, dom, d digits.
def _norm(book: str) -> str:
    return (
        f"select *, coalesce(email, '') as em, {full_name('given_name', 'middle_name', 'family_name')} as f, {name('given_name')} as g, {name('family_name')} as n, {email('email')} as e, {phone('phone')} as p, "
        f"{organization('organization_name')} as o, {address('street', 'city')} as a, {digits('phone')} as d, {display()} as display, {url('url')} as u, {birthday('bd_year', 'bd_month', 'bd_day')} as b from {book}"
    )


def _full(base: str) -> str:
    dm = "case when e <> '' and len(string_split(e, '@')) = 2 then split_part(e, '@', 2) end"
    nick = trim("lower(coalesce(nickname, ''))")
    return f"select *, {name('f')} as sim, {dm} as dm, {soundex('n')} as sx, {nickname('g')} as ni, {nick} as nk from {base}"


BOOKS = f"bl as materialized ({BOOK_LEFT}), br as materialized ({BOOK_RIGHT}), mp as materialized ({MAPPING}), l0 as materialized ({_norm('bl')}), r0 as materialized ({_norm('br')}), l as materialized ({_full('l0')}), r as materialized ({_full('r0')})"

_SIMILAR = "(x.f <> y.f or x.f = '') and x.sim <> '' and y.sim <> '' and levenshtein(x.sim, y.sim) <= 2"


def pairs(x: str, y: str, on: str) -> str:
    """CTE bodies: s (all pairs with components), t (with score), for books x and y joined on a condition."""
    return f"""s as materialized (select x.id as id_a, y.id as id_b,
  case when x.e <> '' and x.e = y.e then 60 else 0 end as email, case when x.p <> '' and x.p = y.p then 60 else 0 end as phone,
  case when x.f <> '' and x.f = y.f then 30 else 0 end as exact_name, case when {_SIMILAR} then 20 else 0 end as similar_name,
  case when x.o <> '' and x.o = y.o then 10 else 0 end as organization, case when x.a <> '' and x.a = y.a then 10 else 0 end as address,
  x.dm <> y.dm as clash, (x.e <> '' or x.p <> '') and (y.e <> '' or y.p <> '') as reachable from {x} x join {y} y on {on}),
t as (select id_a, id_b, email, phone, exact_name, similar_name, organization, address,
  case when exact_name + similar_name > 0 and coalesce(clash, false) then -10 else 0 end as domain_mismatch,
  case when exact_name + similar_name > 0 and email + phone = 0 and reachable then -20 else 0 end as different_info from s),
w as materialized (select *, greatest(0, email + phone + exact_name + similar_name + organization + address + domain_mismatch + different_info) as score from t)"""


REASONS = """list_filter([case when email <> 0 then 'Same email address' end, case when phone <> 0 then 'Same phone number' end, case when exact_name <> 0 then 'Exact name match' end, case when similar_name <> 0 then 'Similar names' end,
  case when organization <> 0 then 'Same company' end, case when address <> 0 then 'Same address' end, case when domain_mismatch <> 0 then '⚠️ Different email domains' end, case when different_info <> 0 then '⚠️ Different contact info' end], lambda v: v is not null)"""


def signals(x: str, y: str) -> str:
    """CTE z: pairs of w that score 30 or more, with the points of each signal."""
    stem = lambda e: f"coalesce(nullif(regexp_extract(regexp_extract({e}, '^([^@]+)@', 1), '^\\+*([^+]+)', 1), ''), regexp_extract({e}, '^([^@]+)@', 1))"
    host = lambda e: f"regexp_extract({e}, '^[^@]+@(.+)$', 1)"
    toks = lambda v: f"list_sort(list_distinct(list_filter(string_split({v}, ' '), lambda q: q <> '')))"
    ex, ey = "lower(x.em)", "lower(y.em)"
    return f"""z as materialized (select w.*, x.n <> '' and x.n = y.n as family,
  split_part(x.g, ' ', 1) <> '' and split_part(y.g, ' ', 1) <> '' and split_part(x.g, ' ', 1) <> split_part(y.g, ' ', 1) and coalesce(x.ni = y.ni, false) as s1,
  x.g <> '' and y.g <> '' and case when length(x.g) = 1 then starts_with(y.g, x.g) when length(y.g) = 1 then starts_with(x.g, y.g) else false end as s2,
  x.f <> y.f and {toks('x.f')} = {toks('y.f')} and len({toks('x.f')}) >= 2 as s3,
  x.sx <> '' and x.sx = y.sx and x.n <> y.n as s4,
  length(x.d) >= 7 and right(x.d, 7) = right(y.d, 7) and x.d <> y.d as s5,
  {ex} <> {ey} and {host(ex)} <> '' and {host(ex)} = {host(ey)} and {stem(ex)} = {stem(ey)} as s6,
  replace(x.f, ' ', '') <> '' and x.f <> y.f and replace(x.f, ' ', '') = replace(y.f, ' ', '') as s7,
  x.nk <> '' and starts_with(y.g, x.nk) as s8, y.nk <> '' and starts_with(x.g, y.nk) as s9
  from w join {x} x on x.id = w.id_a join {y} y on y.id = w.id_b where score >= 30),
v as (select *, cast(s1 as int) * (case when family then 35 else 20 end) + cast(s2 as int) * (case when family then 25 else 10 end) + 20 * cast(s3 as int) + 10 * cast(s4 as int) + 30 * cast(s5 as int) + 40 * cast(s6 as int) + 25 * cast(s7 as int) + 20 * cast(s8 as int) + 20 * cast(s9 as int) as delta,
  array_to_string(list_concat({REASONS}, list_filter([case when s1 then 'Nickname / common name variant' end, case when s2 then 'First-name initial matches full name' end, case when s3 then 'Name components match when reordered' end, case when s4 then 'Surnames sound similar (phonetic match)' end, case when s5 then 'Phone numbers share last 7 digits' end, case when s6 then 'Emails appear to be plus-aliases of each other' end, case when s7 then 'Possible compound / split name format' end, case when s8 then 'Contact''s stored nickname matches other name' end, case when s9 then 'Contact''s stored nickname matches other name' end], lambda q: q is not null)), '; ') as reasoning from z),
k as materialized (select *, least(100, score + delta) as effective from v where least(100, score + delta) >= 50)"""


WITHIN = f"{BOOKS}, {pairs('l', 'l', 'x.id < y.id')}, {signals('l', 'l')}"
ACROSS = f"{BOOKS}, {pairs('l', 'r', '(x.id, y.id) not in (select google_resource_name, mac_contact_identifier from mp)')}, {signals('l', 'r')}"


def diff(x: str = "x", y: str = "y") -> str:
    """list of what differs between a left and a right row of the books."""
    text = lambda f: f"lower({non_blank(f'{x}.{f}')}) is distinct from lower({non_blank(f'{y}.{f}')})"
    tests = [("First name", text("given_name")), ("Last name", text("family_name")), ("Middle name", text("middle_name")), ("Company", text("organization_name")), ("Nickname", text("nickname")), ("Job title", text("job_title")), ("Birthday", f"{x}.b is distinct from {y}.b"), ("Phone numbers", f"{x}.p <> {y}.p"), ("Email addresses", f"{x}.e <> {y}.e"), ("Addresses", f"{x}.a <> {y}.a"), ("Websites", f"{x}.u <> {y}.u")]
    return "list_filter([" + ", ".join(f"case when {t} then '{label} changed' end" for label, t in tests) + "], lambda q: q is not null)"


#: CTEs that lead to plan2 (two-way, deletions synced, alwaysAsk): name, action, direction, changes, user_override, source, left_id, right_id.
TWO_WAY = f"""{BOOKS}, j as materialized (select mp.*, x.id as left_id, y.id as right_id, x.display as dx, y.display as dy, {diff()} as ch, x.mod_day as mx, y.mod_day as my from mp left join l x on x.id = google_resource_name left join r y on y.id = mac_contact_identifier),
m as materialized (select *, coalesce(mx > synced_day, false) as cx, coalesce(my > synced_day, false) as cy from j),
p1 as materialized (select case when left_id is null then dy when right_id is null then dx when not cx and cy then dy else dx end as name,
  case when left_id is null or right_id is null then 'delete' when cx <> cy then 'update' else 'merge' end as action,
  case when left_id is null then 'googleToMac' when right_id is null then 'macToGoogle' when cx and not cy then 'googleToMac' when cy and not cx then 'macToGoogle' else 'twoWay' end as direction,
  case when left_id is null then ['Deleted on Google side'] when right_id is null then ['Deleted on Mac side'] when cx and cy then list_append(ch, '⚠️ Conflict: both sides changed since last sync') when cx or cy then ch else list_append(ch, 'Differs, but neither side reports when it changed') end as changes,
  cast(null as varchar) as user_override, case when left_id is null or (right_id is not null and cy and not cx) then 'mac' else 'google' end as source, left_id, right_id
  from m where (left_id is null) <> (right_id is null) or (left_id is not null and right_id is not null and len(ch) > 0)),
ul as materialized (select *, {full_name('given_name', 'family_name')} as gf, row_number() over (order by id) as no from l where id not in (select google_resource_name from mp)),
ur as materialized (select *, {full_name('given_name', 'family_name')} as gf from r where id not in (select mac_contact_identifier from mp)),
cand as materialized (select x.no, y.id, min(pos) as pos from ul x join ur y on lower({non_blank('x.email')}) = lower({non_blank('y.email')}) cross join (select 0 as pos) group by 1, 2
  union all select x.no, y.id, 1 from ul x join ur y on x.gf <> '' and x.gf = y.gf where lower({non_blank('x.email')}) is distinct from lower({non_blank('y.email')})),
lists as materialized (select no, list({{'id': id, 'pos': pos}} order by pos, id) as c from cand group by no),
walk as (select 0 as no, cast([] as varchar[]) as used, cast(null as struct(id varchar, pos int)) as pick union all
  select w.no + 1, case when pick2 is null then w.used else list_append(w.used, pick2.id) end, pick2 from (select w.no, w.used, list_filter(lists.c, lambda q: not list_contains(w.used, q.id))[1] as pick2 from walk w left join lists on lists.no = w.no + 1 where w.no < (select max(no) from ul)) w),
link as materialized (select ul.id as left_id, pick.id as right_id, pick.pos as pos from walk join ul using (no) where pick is not null),
p2 as materialized (select x.display as name, case when k.right_id is null then 'add' else 'merge' end as action, case when k.right_id is null then 'googleToMac' else 'twoWay' end as direction,
  [case when k.right_id is null then 'New contact from Google' when k.pos = 0 then 'Matched on a shared email address: ' || y.display else 'Possible match: ' || y.display || ' (same name only — review before merging)' end] as changes,
  case when k.pos = 0 then 'merge' end as user_override, 'google' as source, x.id as left_id, k.right_id from ul x left join link k on k.left_id = x.id left join r y on y.id = k.right_id),
own as materialized (select key, min(id) as id from (select id, unnest(list_filter(['email:' || lower({non_blank('email')}), case when length(d) >= 8 then 'phone:' || right(d, 8) end], lambda q: q is not null)) as key from l) group by key),
hit as materialized (select x.id as right_id, coalesce(a.id, b.id) as left_id from ur x left join own a on a.key = 'email:' || lower({non_blank('x.email')}) left join own b on length(x.d) >= 8 and b.key = 'phone:' || right(x.d, 8)),
p3 as materialized (select x.display as name, case when h.left_id is null then 'add' else 'merge' end as action, case when h.left_id is null then 'macToGoogle' else 'twoWay' end as direction,
  [case when h.left_id is null then 'New contact from Mac' else 'Matched an existing Google contact — linking instead of adding a duplicate' end] as changes, cast(null as varchar) as user_override, case when h.left_id is null then 'mac' else 'google' end as source, h.left_id, x.id as right_id
  from ur x join hit h on h.right_id = x.id where x.id not in (select right_id from link) and (x.display <> 'Unnamed contact')),
plan2 as materialized (select * from p1 union all select * from p2 union all select * from p3)"""
PLAN_OUT = "name, action, direction, array_to_string(changes, '; ') as changes, user_override, source, left_id, right_id"
