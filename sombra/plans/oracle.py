"""DuckDB SQL that computes the same results as ``registry`` (the oracle).

RE2 has no look-around, so digit-bounded detectors are rewritten: every
maximal digit run is wrapped in marks (``DO`` … ``DC``), and "no digit next
to it" becomes "starts/ends at a mark".  Offsets are recovered by summing
the unmarked lengths of the pieces before each match.  Whitespace is spelled
out as Java's Unicode White_Space set, since RE2's ``\\s`` is ASCII.

Keyed surrogates use the same HMAC construction with ``sha256`` on blobs.
"""

from __future__ import annotations

from ..functions import surrogates as S
from ..functions.text import MARK_CLOSE as SC, MARK_OPEN as SO, MARK_TAG as TAG
from .registry import CLASSIFY_TABLES, DEMO_KEY, TPCH_FKS

DO, DC, DM = "\ue010", "\ue011", "\ue012"     # digit-run marks and a neutral stand-in
WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SEP = "[-." + WS + "_/*]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# scalar helpers
# ---------------------------------------------------------------------------

def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^[' + WS + ']+|[' + WS + ']+$')}, '', 'g')"


def upper(x: str) -> str:
    """Java's and Python's upper() turn ß into SS; DuckDB's gives ẞ."""
    return f"upper(replace({x}, 'ß', 'ss'))"


def norm(x: str) -> str:
    return strip(upper(f"strip_accents({x})"))


def clean(x: str) -> str:
    return strip(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


def canonical(n: str, fam: str) -> str:
    if fam in ("CPF", "RG", "PHONE", "PLATE", "CHASSI"):
        return f"regexp_replace({n}, '[^0-9A-Z]', '', 'g')"
    if fam == "IP":
        return f"regexp_replace({n}, '[^0-9]+', '.', 'g')"
    if fam == "PER":
        return f"regexp_replace({n}, {q('[' + WS + ']+')}, ' ', 'g')"
    return n


def hmac(msg: str) -> str:
    inner = f"sha256(unhex('{DEMO_KEY.ipad_hex}') || encode({msg}))"
    return f"sha256(unhex('{DEMO_KEY.opad_hex}') || unhex({inner}))"


def digest(value: str, fam: str) -> str:
    return hmac(f"'{fam}:' || {canonical(norm(clean(value)), fam)}")


def byte(h: str, k) -> str:
    return f"(('0x' || substr({h}, ({k}) * 2 + 1, 2))::INTEGER)"


def word(h: str, k) -> str:
    return f"(('0x' || substr({h}, ({k}) * 2 + 1, 4))::INTEGER)"


def digit(h: str, k: int) -> str:
    return f"CAST({byte(h, k)} % 10 AS VARCHAR)"


def letter(h: str, k: int) -> str:
    return f"substr('{S.LETTERS}', {byte(h, k)} % 26 + 1, 1)"


def pick(words: list[str], idx: str) -> str:
    arr = "[" + ", ".join(q(w) for w in words) + "]"
    return f"{arr}[({idx}) % {len(words)} + 1]"


def check_digit(total: str) -> str:
    return f"CAST(((11 - ({total}) % 11) % 11) % 10 AS VARCHAR)"


def cpf_checks(d: list[str]) -> tuple[str, str]:
    s1 = " + ".join(f"CAST({d[i]} AS INTEGER) * {10 - i}" for i in range(9))
    c1 = check_digit(s1)
    s2 = " + ".join(f"CAST({d[i]} AS INTEGER) * {11 - i}" for i in range(9)) + f" + CAST({c1} AS INTEGER) * 2"
    return c1, check_digit(s2)


def cpf_text(d: list[str]) -> str:
    return " || ".join([d[0], d[1], d[2], "'.'", d[3], d[4], d[5], "'.'", d[6], d[7], d[8], "'-'", *cpf_checks(d)])


def let_sql(name: str, value: str, body: str) -> str:
    """``value`` bound once under ``name`` in ``body``."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def permuted_cpf(canon: str) -> str:
    """Formatted CPF after four Feistel rounds over the nine payload digits."""
    def turn(r: int, x: str, size: int) -> str:
        h = hmac(f"'CPF{r}:' || CAST({x} AS VARCHAR)")
        return f"CAST('0x' || substr({h}, 1, 12) AS BIGINT) % {size}"

    left, right = 10 ** 4, 10 ** 5
    digits = [f"substr(dd, {k + 1}, 1)" for k in range(9)]
    out = let_sql("dd", "lpad(CAST(l2 AS VARCHAR), 4, '0') || lpad(CAST(r2 AS VARCHAR), 5, '0')", cpf_text(digits))
    out = let_sql("r2", f"(r1 + {turn(3, 'l2', right)}) % {right}", out)
    out = let_sql("l2", f"(l1 + {turn(2, 'r1', left)}) % {left}", out)
    out = let_sql("r1", f"(CAST(substr(cn, 5, 5) AS BIGINT) + {turn(1, 'l1', right)}) % {right}", out)
    out = let_sql("l1", f"(CAST(substr(cn, 1, 4) AS BIGINT) + {turn(0, 'CAST(substr(cn, 5, 5) AS BIGINT)', left)}) % {left}", out)
    return let_sql("cn", canon, out)


def fake(tag: str, h: str, real: str | None = None) -> str:
    fam = S.family(tag)
    if fam == "CPF":
        canon = canonical(norm(clean(real)), "CPF")
        # every CPF of the registered queries has valid check digits
        return permuted_cpf(canon)
    if fam == "RG":
        d = [digit(h, k) for k in range(9)]
        return " || ".join([d[0], d[1], "'.'", d[2], d[3], d[4], "'.'", d[5], d[6], d[7], "'-'", d[8]])
    if fam == "PLATE":
        l = [letter(h, k) for k in range(4)]
        n = [digit(h, k) for k in (4, 5, 6, 7)]
        old = " || ".join([l[0], l[1], l[2], "'-'", n[0], n[1], n[2], n[3]])
        new = " || ".join([l[0], l[1], l[2], n[0], l[3], n[1], n[2]])
        return f"(CASE WHEN {byte(h, 8)} % 2 = 0 THEN {old} ELSE {new} END)"
    if fam == "EMAIL":
        return (f"lower({pick(S.FIRST_NAMES, word(h, 0))} || '.' || {pick(S.LAST_NAMES, word(h, 2))}"
                f" || '.' || substr({h}, 9, 12) || '@{S.EMAIL_DOMAIN}')")
    if fam == "PHONE":
        d = [digit(h, k) for k in range(1, 9)]
        return (f"'(' || CAST({byte(h, 0)} % 89 + 11 AS VARCHAR) || ') 9' || "
                + " || ".join(d[:4]) + " || '-' || " + " || ".join(d[4:]))
    if fam == "IP":
        return " || '.' || ".join(f"CAST({byte(h, k)} AS VARCHAR)" for k in range(4))
    if fam == "CHASSI":
        return " || ".join(f"substr('{S.VIN_ALPHABET}', {byte(h, k)} % 33 + 1, 1)" for k in range(17))
    if fam == "PER":
        first = pick(S.FIRST_NAMES, word(h, 0))
        last = pick(S.LAST_NAMES, word(h, 2))
        nxt = pick(S.LAST_NAMES, word(h, 2) + " + 1")
        real_last = f"string_split({canonical(norm(clean(real)), 'PER')}, ' ')[-1]"
        return f"{first} || ' ' || (CASE WHEN {last} = {real_last} THEN {nxt} ELSE {last} END)"
    return pick(S.WORDS, word(h, 0))


def surrogate(tag: str, value: str) -> str:
    h = digest(value, S.family(tag))
    return fake(tag, h, value)


def jitter(value: str) -> str:
    h = digest(value, "COORD")
    v = clean(value)
    marked = f"string_split(regexp_replace({v}, '-?[0-9]{{1,3}}[.,][0-9]{{3,}}', '{SO}\\0{SC}', 'g'), '{SO}')"
    num = f"split_part(p, '{SC}', 1)"
    tail = f"split_part(p, '{SC}', 2)"
    micro = f"({word(h, '((i - 1) * 2) % 30')} % 6001 - 3000)"
    moved = (f"CAST(CAST(replace({num}, ',', '.') AS DECIMAL(12,6)) + "
             f"CAST({micro} AS DECIMAL(12,0)) / 1000000 AS DECIMAL(12,6))")
    body = f"CASE WHEN i = 1 THEN p ELSE CAST({moved} AS VARCHAR) || {tail} END"
    return f"array_to_string(list_transform({marked}, lambda p, i: {body}), '')"


# ---------------------------------------------------------------------------
# detectors
# ---------------------------------------------------------------------------

def g(a: int, b: int | None) -> str:
    rng = f"{{{a},{b}}}" if b is not None else f"{{{a},}}"
    return f"{DO}[0-9]{rng}{DC}"


# stated again here, not taken from the engine
EMAIL_RE = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
DIGIT_RE = {
    "CPF": f"{DO}(?:[0-9](?:{DC}{SEP}{{1,4}}{DO})?){{10}}[0-9]{DC}",
    "IP": f"(?:{g(1, 3)}[_.\\-{WS}]+){{3}}{g(1, 3)}",
    "RG": (f"{DO}(?:[0-9](?:{DC}{SEP}{{1,4}}{DO})?){{5,8}}[0-9]"
           f"(?:(?:{DC}{SEP}{{1,4}}{DO})?[0-9]{DC}|{DC}{SEP}{{0,4}}[Xx])"),
    "COORD_SINGLE": f"-?{g(1, 3)}[.,]{g(3, None)}",
    "COORD": f"-?{g(1, 3)}[.,]{g(3, None)}[^A-Za-z0-9{DO}{DC}]+-?{g(1, 3)}[.,]{g(3, None)}",
    "DATE_TIME": (f"{g(1, 4)}[/.\\-\\\\]{g(1, 2)}[/.\\-\\\\]{g(2, 4)}"
                  f"(?:[-.{WS}_]+{g(1, 2)}[:hH]{g(1, 2)}(?::{g(1, 2)})?)?"),
}


def marked_text(tag: str, col: str = "text") -> str:
    m = f"regexp_replace({col}, '([0-9]+)', '{DO}\\1{DC}', 'g')"
    if tag in ("COORD", "COORD_SINGLE"):
        m = f"replace({m}, '{DC}-{DO}', '{DC}{DM}{DO}')"
    if tag == "RG":
        m = f"regexp_replace({m}, '([Xx]){DO}', '{DM}{DO}', 'g')"
    return m


def unmark(v: str) -> str:
    return f"replace(regexp_replace({v}, '[{DO}{DC}]', '', 'g'), '{DM}', '-')"


def matches_sql(tag: str, pattern: str, marked: str, fix_value) -> str:
    wrapped = f"regexp_replace({marked}, {q(pattern)}, '{SO}\\0{SC}', 'g')"
    return f"""
WITH m AS (SELECT doc_id, string_split({wrapped}, '{SO}') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS idx FROM m),
w AS (SELECT doc_id, idx, p,
        COALESCE(SUM(length(regexp_replace(p, '[{SC}{DO}{DC}]', '', 'g'))) OVER (
          PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM u)
SELECT doc_id, CAST(idx - 1 AS INTEGER) AS match_no, CAST(start AS INTEGER) AS start,
       CAST(start + length({fix_value("split_part(p, '" + SC + "', 1)")}) AS INTEGER) AS "end",
       {fix_value("split_part(p, '" + SC + "', 1)")} AS value
FROM w WHERE idx > 1
"""


def find_email_sql() -> str:
    return matches_sql("EMAIL", EMAIL_RE, "text", lambda v: v)


def find_digit_sql(tag: str) -> str:
    return matches_sql(tag, DIGIT_RE[tag], marked_text(tag), unmark)


# ---------------------------------------------------------------------------
# text masking, e-mail profile
# ---------------------------------------------------------------------------

def mask_email_text(col: str) -> str:
    shielded = f"regexp_replace({col}, '<[^>]+>', ' {TAG} ', 'g')"
    tags = f"regexp_extract_all({col}, '<[^>]+>')"
    parts = f"string_split(regexp_replace({shielded}, {q(EMAIL_RE)}, '{SO}\\0{SC}', 'g'), '{SO}')"
    v = f"split_part(p, '{SC}', 1)"
    body = f"CASE WHEN i = 1 THEN p ELSE {surrogate('EMAIL', v)} || split_part(p, '{SC}', 2) END"
    spliced = f"array_to_string(list_transform({parts}, lambda p, i: {body}), '')"
    restored = (f"array_to_string(list_transform(regexp_split_to_array({spliced}, ' {TAG} |{TAG}'), "
                f"lambda p, i: p || COALESCE({tags}[i], '')), '')")
    return (f"CASE WHEN {col} IS NULL OR {strip(col)} = '' THEN {col} "
            f"WHEN len({tags}) = 0 THEN {spliced} ELSE {restored} END")


# ---------------------------------------------------------------------------
# the SQL per query
# ---------------------------------------------------------------------------

def cpf_source(k: str) -> str:
    c1, c2 = cpf_checks([f"substr(pl, {i + 1}, 1)" for i in range(9)])
    return let_sql("pl", f"lpad(CAST(({k} * 7919) % 1000000000 AS VARCHAR), 9, '0')", f"pl || {c1} || {c2}")


def coord_source(k: str) -> str:
    return (f"'-' || CAST({k} % 89 AS VARCHAR) || '.' || lpad(CAST(({k} * 37) % 10000 AS VARCHAR), 4, '0')"
            f" || ',-' || CAST({k} % 179 AS VARCHAR) || '.' || lpad(CAST(({k} * 53) % 10000 AS VARCHAR), 4, '0')")


def shaped_sources(k: str) -> dict[str, str]:
    pad = lambda x, n: f"lpad(CAST(({x}) % {10 ** n} AS VARCHAR), {n}, '0')"
    rg, tel = pad(f"{k} * 7919", 8), pad(f"{k} * 104729", 8)
    return {
        "RG": f"substr({rg}, 1, 2) || '.' || substr({rg}, 3, 3) || '.' || substr({rg}, 6, 3) || '-' || "
              f"CASE WHEN {k} % 11 = 10 THEN 'x' ELSE CAST({k} % 11 AS VARCHAR) END",
        "PHONE": f"'(' || ({k} % 89 + 11) || ') 9' || substr({tel}, 1, 4) || '-' || substr({tel}, 5, 4)",
        "IP": " || '.' || ".join(f"({k} * {m} % 256)" for m in (3, 7, 11, 13)),
        "CHASSI": f"'9bw zzz-377vt' || {pad(f'{k} * 31', 6)}",
        "PLATE": f"'a' || substr('BCDEFGHJKL', CAST({k} % 10 + 1 AS INTEGER), 1) || 'c-' || {pad(f'{k} * 17', 4)}",
        "EMAIL": f"' User' || {k} || '@Exemplo.COM '",
    }


def mask_shapes_sql() -> str:
    src = shaped_sources("c_custkey")
    inner = ", ".join(f"{x} AS src_{t}" for t, x in src.items())
    return (f"SELECT c_custkey, {', '.join(f'src_{t}, ' + surrogate(t, f'src_{t}') + f' AS masked_{t}' for t in src)} "
            f"FROM (SELECT c_custkey, {inner} FROM customer)")


def mask_values_sql(tag: str) -> str:
    src = cpf_source("c_custkey")
    return (f"SELECT c_custkey, {src} AS src, {surrogate(tag, src)} AS masked FROM customer")


def _core_queries() -> dict[str, str]:
    out = {"find_email": find_email_sql()}
    for t, name in [("CPF", "find_cpf"), ("IP", "find_ip"), ("RG", "find_rg"),
                    ("COORD", "find_coord"), ("COORD_SINGLE", "find_coord_single"),
                    ("DATE_TIME", "find_datetime")]:
        out[name] = find_digit_sql(t)
    out["seed_customer"] = (f"SELECT c_custkey, {norm('c_name')} AS norm, "
                            f"{digest('c_name', 'PER')} AS seed_hex FROM customer")
    for tag, name in [("CPF", "mask_cpf"), ("RG", "mask_rg"), ("PLATE", "mask_plate"),
                      ("PHONE", "mask_phone"), ("IP", "mask_ipv4"), ("CHASSI", "mask_vin"),
                      ("EMAIL", "mask_email"), ("OTHER", "mask_word")]:
        out[name] = mask_values_sql(tag)
    out["mask_person"] = f"SELECT c_custkey, {surrogate('PER', 'c_name')} AS masked FROM customer"
    src = coord_source("o_orderkey")
    out["jitter_coord"] = f"SELECT o_orderkey, {src} AS src, {jitter(src)} AS masked FROM orders"
    out["masked_join"] = """
SELECT c_mktsegment, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""
    out["mask_documents_email"] = f"SELECT doc_id, {mask_email_text('text')} AS masked FROM documents"
    out["mask_pages_email"] = f"SELECT page_id, {mask_email_text('html')} AS html FROM pages"
    out["strip_shield_roundtrip"] = "SELECT page_id, html FROM pages"
    out["stitch_pages"] = """
SELECT conv_id, string_agg(text || chr(10) || chr(10), '' ORDER BY turn) AS text
FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id"""
    shown = "html"
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        shown = f"replace({shown}, {q(char)}, {q(name)})"
    out["escape_pages"] = f"SELECT page_id, {shown} AS shown, html FROM pages"
    out["latin1_text"] = "SELECT doc_id, regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') AS text FROM documents"
    out["fit_length"] = "SELECT * REPLACE (left(p_name, 10) AS p_name, left(p_type, 6) AS p_type) FROM part"
    out["quarantine_split"] = """
SELECT p_partkey, CASE WHEN reason = '' THEN 'accepted' ELSE 'quarantine' END AS status, reason
FROM (SELECT p_partkey, concat_ws('; ', CASE WHEN length(p_name) > 11 THEN 'p_name longer than 11' END,
        CASE WHEN length(p_type) > 7 THEN 'p_type longer than 7' END,
        CASE WHEN p_brand IS NULL THEN 'p_brand is null' END) AS reason FROM part)"""
    out["direct_copy"] = "SELECT * FROM orders"
    out["csv_roundtrip"] = """SELECT doc_id, lang, coalesce(text || chr(13) || chr(10), '') || '"fim", ;' || chr(10) AS text
                              FROM documents"""
    allow = ["customer", "orders", "lineitem", "part", "documents", "events"]
    out["column_catalogue"] = f"""
SELECT DISTINCT table_name, column_name, table_name || '.' || column_name AS qualified
FROM information_schema.columns
WHERE table_name IN ({", ".join(q(t) for t in allow)})
  AND table_name || '.' || column_name NOT IN ('orders.o_comment', 'customer.c_acctbal')
ORDER BY table_name, column_name"""
    edges = []
    for child, parent, cc, pc in TPCH_FKS:
        if child == parent:
            continue
        edges.append(f"""SELECT '{child}' AS child, '{parent}' AS parent, '{cc}' AS child_col,
  (SELECT COUNT(*) FROM {child} c WHERE c.{cc} IS NOT NULL
     AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pc} = c.{cc})) AS orphans""")
    out["fk_orphans"] = "\nUNION ALL\n".join(edges)
    lacking = lambda child, keys, parent, pairs, label: (
        f"SELECT '{child}' AS child, '{label}' AS parent, '{keys}' AS child_col, COUNT(*) AS orphans FROM {child} c "
        f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {' AND '.join(f'p.{b} = c.{a}' for a, b in pairs)})")
    out["fk_orphans_masked"] = " UNION ALL ".join([
        lacking("orders", "o_custkey", "(SELECT * FROM customer WHERE c_acctbal > 0)", [("o_custkey", "c_custkey")], "solvent")
        + " AND o_custkey IS NOT NULL",
        lacking("documents", "doc_id", "labels", [("doc_id", "doc_id")], "labels") + " AND doc_id IS NOT NULL",
        lacking("lineitem", "l_partkey, l_suppkey", "(SELECT * FROM lineitem WHERE l_linenumber = 1)",
                [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")], "first_lines")
        + " AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL"])
    out["run_speed_30"] = """
SELECT event_id, user_id,
       SUM(CAST(value AS DECIMAL(18,2))) OVER w AS sum_30, COUNT(*) OVER w AS n_30,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / COUNT(*) OVER w AS mean_30
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
    return out


# ---------------------------------------------------------------------------
# classifier (C1-C11).  For a FIRST match, a look-behind/ahead equals a
# consumed boundary character (or ^/$); the detector is group 2.
# ---------------------------------------------------------------------------

CLASSIFY_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type", "props"],
    "pages": ["url", "html"], "conversations": ["role", "text"], "benchmark": ["text"],
    "documents": ["text", "lang", "source"], "lineitem": ["l_returnflag", "l_linestatus"],
}
_S = "[" + WS + "]"
_CORE = {
    "CPF": ("[^0-9]", f"(?:[0-9][-.{WS}_/*]{{0,4}}){{10}}[0-9]", "[^0-9]"),
    "IP": ("[^0-9]", f"(?:[0-9]{{1,3}}[_.\\-{WS}]+){{3}}[0-9]{{1,3}}", "[^0-9]"),
    "RG": ("[^0-9]", f"(?:[0-9][-.{WS}_/*]{{0,4}}){{6,9}}[0-9Xx]", "[^0-9]"),
    "PLATE": ("[^A-Za-z]", f"(?:[A-Za-z][-.{WS}_]*){{3}}[0-9][-.{WS}_]*[A-Za-z0-9][-.{WS}_]*[0-9][-.{WS}_]*[0-9]",
              "[^A-Za-z0-9]"),
    "PHONE": ("[^0-9]", f"(?:\\+?55[-.{WS}_]*)?(?:\\(?[0]?[0-9]{{2}}\\)?[-.{WS}_]*)?(?:9[-.{WS}_]*)?"
                        f"[0-9]{{4,5}}[-.{WS}_]*[0-9]{{4}}", "[^0-9]"),
    "CHASSI": ("[^A-Za-z0-9]", f"(?i:(?:[A-HJ-NPR-Z0-9][\\-{WS}]*){{16}}[A-HJ-NPR-Z0-9])", "[^A-Za-z0-9]"),
    "DATE_TIME": ("[^0-9]", f"[0-9]{{1,4}}[/.\\-\\\\][0-9]{{1,2}}[/.\\-\\\\][0-9]{{2,4}}"
                            f"(?:[-.{WS}_]+[0-9]{{1,2}}[:hH][0-9]{{1,2}}(?::[0-9]{{1,2}})?)?", "[^0-9]"),
    "COORD": ("[^0-9]", "-?[0-9]{1,3}[.,][0-9]{3,}[^A-Za-z0-9]+-?[0-9]{1,3}[.,][0-9]{3,}", "[^0-9]"),
    "COORD_SINGLE": ("[^0-9]", "-?[0-9]{1,3}[.,][0-9]{3,}", "[^0-9]"),
}


def first_match_len(v: str, tag: str) -> str:
    if tag == "EMAIL":
        return f"length(regexp_extract({v}, {q(EMAIL_RE)}, 0))"
    pre, core, post = _CORE[tag]
    return f"length(regexp_extract({v}, {q('(^|' + pre + ')(' + core + ')($|' + post + ')')}, 2))"


def has_match(v: str, tag: str) -> str:
    pre, core, post = _CORE[tag]
    return f"regexp_matches({v}, {q('(^|' + pre + ')(' + core + ')($|' + post + ')')})"


def coordinate_cover(v: str) -> str:
    """Share of letters and digits that coordinates cover, other spans taken out."""
    money = (f"(?:R\\$|US\\$|\\$|€)[{WS}]*[0-9][0-9.,]*|[0-9][0-9.,]*[{WS}]*(?:mil[{WS}]+)?(?:reais|real|euros?)\\b")
    rest = f"regexp_replace(regexp_replace({v}, {q(EMAIL_RE)}, ' ', 'g'), {q(money)}, ' ', 'g')"
    rest = f"regexp_replace({rest}, '([0-9]+)', '{DO}\\1{DC}', 'g')"
    for tag in ("CPF", "DATE_TIME"):
        rest = f"regexp_replace({rest}, {q(DIGIT_RE[tag])}, ' ', 'g')"
    rest = f"replace({rest}, '{DC}-{DO}', '{DC}{DM}{DO}')"
    written = lambda x: f"length(regexp_replace({x}, '[^\\pL\\pN]', '', 'g'))"
    single = DIGIT_RE["COORD_SINGLE"]
    return f"(({written(rest)} - {written(f'regexp_replace({rest}, {q(single)}, {q(chr(32))}, {q(chr(103))})')}) / greatest({written(v)}, 1))"


def identity_sql() -> str:
    """The registry's identity_table."""
    k = "c_custkey"
    pad = lambda x, n: f"lpad(CAST(({x}) % {10 ** n} AS VARCHAR), {n}, '0')"
    letter = lambda m: f"substr('ABCDEFGHJK', CAST({k} * {m} % 10 + 1 AS INTEGER), 1)"
    return (f"SELECT c_custkey, {cpf_source(k)} AS nr_documento, 'user' || {k} || '@example.com' AS contato, "
            f"{letter(1)} || {letter(3)} || {letter(7)} || {pad(k, 1)} || {letter(9)} || {pad(k + ' * 31', 2)} AS veiculo, "
            f"'-' || CAST({k} % 89 AS VARCHAR) || '.' || {pad(k + ' * 37', 6)} AS posicao, "
            f"'01/02/20' || {pad(k, 2)} AS quando, c_mktsegment, c_acctbal FROM customer")


TOKEN_RE = r"\pL[\pL\pM'’\-]*|[^\pL" + WS + "]+"
PARTICLES = ["DE", "DA", "DO", "DOS", "DAS", "E", "DI", "DEL"]


def named_person(k: str) -> str:
    title = lambda x: f"(upper({x}[1]) || lower({x}[2:]))"
    first, last = pick(S.FIRST_NAMES, f"({k} * 7 + 3)"), pick(S.LAST_NAMES, f"({k} * 11 + 5)")
    return f"({title(first)} || CASE WHEN {k} % 3 = 0 THEN ' de ' ELSE ' ' END || {title(last)})"


def name_runs_sql(source: str, min_words: int) -> str:
    """(doc_id, start, end, n_words): runs of dictionary words in ``source``
    (doc_id, text), particles inside."""
    names = ", ".join(q(n) for n in [*S.FIRST_NAMES, *S.LAST_NAMES])
    parts = ", ".join(q(n) for n in PARTICLES)
    toks = matches_sql("WORD", TOKEN_RE, "text", lambda v: v).replace("FROM documents", f"FROM ({source})")
    return f"""
SELECT doc_id, CAST(min(CASE WHEN word = 1 THEN start END) AS INTEGER) AS start,
       CAST(max(CASE WHEN word = 1 THEN "end" END) AS INTEGER) AS "end", CAST(sum(word) AS INTEGER) AS n_words
FROM (SELECT *, match_no - row_number() OVER (PARTITION BY doc_id ORDER BY match_no) AS run
      FROM (SELECT *, CASE WHEN {norm('value')} IN ({names}) THEN 1 WHEN {norm('value')} IN ({parts}) THEN 0 END AS word
            FROM ({toks})) WHERE word IS NOT NULL)
GROUP BY doc_id, run HAVING sum(word) >= {min_words}
"""


def trim_sql() -> str:
    """D16 with list functions: drop the leading closed-class words, then keep
    tokens up to the first that ends a name."""
    lead = ", ".join(q(w) for w in (
        "a o as os um uma uns umas de da do das dos em na no nas nos ao aos à às por pela pelo pelas pelos para com sem sob "
        "sobre entre até desde contra este esta esse essa aquele aquela seu sua meu minha").split())
    aux = ", ".join(q(w) for w in ("é são foi foram era eram está estão estava estavam tem têm tinha tinham ser estar ter há "
                                   "havia vai vão").split())
    token = f"(?:\\pL[\\pL\\pM'’\\-]*|[0-9][0-9.,]*|[^{WS}])[{WS}]*"
    return f"""
WITH c AS (SELECT doc_id, 'da ' || left(text, 60) AS raw FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, regexp_extract_all(raw, {q(token)}) AS ts FROM c),
w AS (SELECT doc_id, ts, list_transform(ts, lambda x: lower({strip('x')})) AS ws FROM t),
a AS (SELECT *, coalesce(list_position(list_transform(ws, lambda x: x NOT IN ({lead})), true), len(ws) + 1) AS i FROM w),
b AS (SELECT *, coalesce(list_position(list_transform(ws[i:], lambda x: NOT regexp_matches(x, '^\\pL') OR x IN ({aux})), true),
                         len(ws) + 1) AS j FROM a)
SELECT doc_id, {strip("array_to_string(ts[i:i + j - 2], '')")} AS value,
       CAST(length(array_to_string(ts[1:i - 1], '')) AS INTEGER) AS skip
FROM b
"""


def classify_sql(columns: dict[str, list[str]] | None = None, sources: dict[str, str] | None = None, names: bool = False) -> str:
    from ..operators import classify as C
    from ..functions import patterns as PP
    columns = columns or CLASSIFY_COLUMNS
    longs = []
    for t, cols in columns.items():
        for c in cols:
            longs.append(f"SELECT '{t}' AS tbl, '{c}' AS col, {strip(c)} AS value FROM {(sources or {}).get(t, t)}")
    long = "\nUNION ALL\n".join(longs)
    nulls = ", ".join(q(x) for x in PP.NULL_TOKENS)
    vote = {t: f"(CAST({first_match_len('value', t)} AS DOUBLE) / greatest(length(value), 1) >= 0.8)"
            for t in C.VOTE_TYPES}
    is_doc = " OR ".join(vote[t] for t in C.DOCUMENT_SHAPES)
    feats = ",\n  ".join([
        f"CAST({coordinate_cover('value')} > 0.5 AND NOT (({is_doc}) AND NOT regexp_matches(value, '^[-+]?[0-9]{{1,3}}[.,][0-9]{{3,}}$')) AS INTEGER) AS gps",
        f"CAST({has_match('value', 'COORD')} AS INTEGER) AS pair",
        f"len(regexp_split_to_array(value, {q('[' + WS + ']+')})) AS words",
        f"CAST(regexp_matches(value, {q('[,.!?][' + WS + ']+[A-Z]')}) AS INTEGER) AS punct",
    ] + [f"CAST({vote[t]} AS INTEGER) AS v_{t}" for t in C.VOTE_TYPES])
    pairs = [(t, c) for t, cols in columns.items() for c in cols]
    score_rows = []
    for i, tag in enumerate(C.TAG_PRIORITY):
        if tag in C.VOTE_TYPES:
            hinted = [f"(tbl = '{t}' AND col = '{c}')" for t, c in pairs if tag in C.name_hints(c)]
            hint = f" + CASE WHEN {' OR '.join(hinted)} THEN n * 0.4 ELSE 0 END" if hinted else ""
            s = f"v_{tag}{hint}"
        elif tag == "TEXTO_LIVRE":
            s = "CASE WHEN mean_words >= 3 OR any_punct = 1 THEN n * 0.8 ELSE 0 END"
        else:
            s = "coalesce((SELECT votes FROM nv WHERE nv.tbl = agg.tbl AND nv.col = agg.col), 0)" if names else "0.0"
        score_rows.append(f"SELECT tbl, col, '{tag}' AS tag, CAST({s} AS DOUBLE) AS score, {i} AS prio FROM agg")
    ignored = [f"(tbl = '{t}' AND col = '{c}')" for t, c in pairs if C.name_is_ignored(c)]
    ign = " OR ".join(ignored) if ignored else "FALSE"
    tagmap = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PP.TAG_TO_POLICY.items())
    runs = name_runs_sql("SELECT tbl || '|' || col || '|' || rk AS doc_id, value AS text FROM samples", 1)
    nv = f"""nv AS (SELECT s.tbl, s.col, COUNT(*) AS votes FROM samples s
      JOIN (SELECT doc_id, SUM("end" - start) AS covered FROM ({runs}) GROUP BY doc_id) r
        ON r.doc_id = s.tbl || '|' || s.col || '|' || s.rk
      WHERE r.covered >= 0.8 * greatest(length(s.value), 1) GROUP BY s.tbl, s.col),
""" if names else ""
    all_pairs = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col" for t, c in pairs)
    return f"""
WITH long AS ({long}),
vals AS (SELECT DISTINCT tbl, col, value FROM long
         WHERE value IS NOT NULL AND upper(value) NOT IN ({nulls})),
samples AS (SELECT * FROM (SELECT tbl, col, value,
              row_number() OVER (PARTITION BY tbl, col ORDER BY md5(value), value) AS rk FROM vals)
            WHERE rk <= 50),
feats AS (SELECT tbl, col,
  {feats}
  FROM samples),
agg AS (SELECT tbl, col, COUNT(*) AS n, AVG(gps) AS gps_share, MAX(pair) AS any_pair,
          AVG(words) AS mean_words, MAX(punct) AS any_punct,
          {", ".join(f"CAST(SUM(v_{t}) AS DOUBLE) AS v_{t}" for t in C.VOTE_TYPES)}
        FROM feats GROUP BY tbl, col),
{nv}scores AS ({" UNION ALL ".join(score_rows)}),
pos AS (SELECT * FROM scores WHERE score > 0),
best AS (SELECT tbl, col, tag, score FROM (SELECT *, row_number() OVER (PARTITION BY tbl, col
           ORDER BY score DESC, prio ASC) AS r FROM pos) WHERE r = 1),
total AS (SELECT tbl, col, SUM(score) AS total FROM pos GROUP BY tbl, col),
decided AS (
  SELECT a.tbl, a.col, a.n, a.gps_share, a.any_pair, b.tag AS best_tag, b.score / a.n AS conf,
         COALESCE(t.total, 0) AS total
  FROM agg a LEFT JOIN best b USING (tbl, col) LEFT JOIN total t USING (tbl, col)),
scored AS (
  SELECT tbl AS "table", col AS "column",
    CASE WHEN gps_share >= 0.5 THEN CASE WHEN any_pair = 1 THEN 'COORD' ELSE 'COORD_SINGLE' END
         WHEN best_tag IS NOT NULL AND conf >= 0.6 THEN CASE best_tag {tagmap} ELSE best_tag END
         WHEN {ign.replace('tbl', 'decided.tbl').replace('col', 'decided.col') if ignored else 'FALSE'} THEN 'IGNORAR'
         WHEN total > 0 THEN 'TEXTO_LIVRE' ELSE 'IGNORAR' END AS tag,
    round(CASE WHEN gps_share >= 0.5 THEN gps_share ELSE COALESCE(conf, 0.0) END, 6) AS confidence,
    CAST(n AS INTEGER) AS n_samples
  FROM decided)
SELECT * FROM scored
UNION ALL
SELECT p.tbl, p.col, 'TEXTO_LIVRE', 0.0, 0 FROM ({all_pairs}) p
WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s."table" = p.tbl AND s."column" = p.col)
"""



def audit_email_sql() -> str:
    """A3/A4 for the e-mail profile: e-mails outside markup are the spans."""
    shielded = f"regexp_replace(text, '<[^>]+>', ' {TAG} ', 'g')"
    nonblank = f"(text IS NOT NULL AND {strip('text')} <> '')"
    return f"""
WITH d AS (SELECT {nonblank} AS evaluated,
                  CASE WHEN {nonblank} THEN len(regexp_extract_all({shielded}, {q(EMAIL_RE)})) ELSE 0 END AS n
           FROM documents)
SELECT 'cells_evaluated' AS metric, CAST(SUM(CAST(evaluated AS INTEGER)) AS BIGINT) AS value FROM d
UNION ALL SELECT 'cells_changed', CAST(SUM(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) FROM d
UNION ALL SELECT 'span_substitutions', CAST(SUM(n) AS BIGINT) FROM d
UNION ALL SELECT 'propagated_substitutions', CAST(0 AS BIGINT)
UNION ALL SELECT 'persons_protected', CAST(0 AS BIGINT)
UNION ALL SELECT 'documents_protected', CAST(0 AS BIGINT)"""


def fragment_sql() -> str:
    """D22 by recursion over each document's newline-closed pieces."""
    return """
WITH RECURSIVE pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n*') AS p FROM documents WHERE text IS NOT NULL)
),
nz AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
       FROM pieces WHERE piece <> ''),
walk AS (
  SELECT doc_id, i, length(piece) AS cur, 0 AS frag,
         (length(piece) > 1000 AND contains(piece, chr(10))) AS closes, length(piece) AS plen
  FROM nz WHERE i = 1
  UNION ALL
  SELECT w.doc_id, n.i,
         CASE WHEN w.closes THEN length(n.piece) ELSE w.cur + length(n.piece) END,
         CASE WHEN w.closes THEN w.frag + 1 ELSE w.frag END,
         (CASE WHEN w.closes THEN length(n.piece) ELSE w.cur + length(n.piece) END) > 1000
           AND contains(n.piece, chr(10)),
         length(n.piece)
  FROM walk w JOIN nz n ON n.doc_id = w.doc_id AND n.i = w.i + 1
)
SELECT doc_id, CAST(frag AS INTEGER) AS frag_no, CAST(SUM(plen) AS INTEGER) AS n_chars
FROM walk GROUP BY doc_id, frag"""



# VIN: look-arounds are "no ASCII letter or digit next to it", so maximal
# alphanumeric runs are wrapped in marks instead of digit runs.
AO, AC = "\ue013", "\ue014"
CHASSI_RE = (f"{AO}(?:(?i:[A-HJ-NPR-Z0-9])(?:{AC}[\\-{WS}]+{AO})?){{16}}(?i:[A-HJ-NPR-Z0-9]){AC}")


def find_chassi_sql() -> str:
    marked = f"regexp_replace(text, '([A-Za-z0-9]+)', '{AO}\\1{AC}', 'g')"
    wrapped = f"regexp_replace({marked}, {q(CHASSI_RE)}, '{SO}\\0{SC}', 'g')"
    fix = lambda v: f"regexp_replace({v}, '[{AO}{AC}]', '', 'g')"
    return f"""
WITH m AS (SELECT doc_id, string_split({wrapped}, '{SO}') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS idx FROM m),
w AS (SELECT doc_id, idx, p,
        COALESCE(SUM(length(regexp_replace(p, '[{SC}{AO}{AC}]', '', 'g'))) OVER (
          PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM u)
SELECT doc_id, CAST(idx - 1 AS INTEGER) AS match_no, CAST(start AS INTEGER) AS start,
       CAST(start + length({fix("split_part(p, '" + SC + "', 1)")}) AS INTEGER) AS "end",
       {fix("split_part(p, '" + SC + "', 1)")} AS value
FROM w WHERE idx > 1"""



# Name candidates (D12, D13, D15, D17).  Unicode \b is rebuilt without
# look-around: every non-word character is followed by a marker NM, so
# "boundary before" is "after NM or at the start", and "boundary after"
# consumes the non-word character but leaves its NM for the next match.
NM = "\ue020"
_NONWORD = "[^\\pL\\pN_" + NM + "]"
_WSM = f"(?:[{WS}]{NM})"


def _words_re() -> str:
    w = "[A-ZÀ-Ÿa-zà-ÿ]{2,20}"
    return f"{w}(?:{_WSM}+{w}){{1,5}}"


def upper_run_re() -> str:
    up = "[A-ZÀ-Ÿ]{2,}"
    core = f"{up}(?:{_WSM}+(?:DE|DA|DO|DOS|DAS|E|DI)?{_WSM}*{up}){{1,5}}"
    return f"(^|{NM})({core})($|{_NONWORD})"


def role_re() -> str:
    from ..functions import patterns as PP
    words = "|".join(PP.ROLE_CONTEXT_WORDS)
    pre = f"(?i:(?:^|{NM})(?:{words})(?:$|{_NONWORD})(?:[^\\n]*?[:\\-.)]{NM})?{_WSM}*)"
    return f"({pre})((?i:{_words_re()}))($|{_NONWORD})"


def _name_matches(col: str, pattern: str, id_col: str, table: str) -> str:
    marked = f"regexp_replace({col}, '([^\\pL\\pN_])', '\\1{NM}', 'g')"
    wrapped = f"regexp_replace({marked}, {q(pattern)}, '\\1{SO}\\2{SC}\\3', 'g')"
    return f"""
SELECT {id_col} AS doc_id, idx, p,
       COALESCE(SUM(length(regexp_replace(p, '[{SC}{NM}]', '', 'g'))) OVER (
         PARTITION BY {id_col} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
FROM (SELECT {id_col}, unnest(parts) AS p, generate_subscripts(parts, 1) AS idx
      FROM (SELECT {id_col}, string_split({wrapped}, '{SO}') AS parts FROM {table} WHERE {col} IS NOT NULL))"""


def _keep(v: str) -> str:
    from ..functions import patterns as PP
    stop = "(?i)(^|[^\\pL\\pN_])(?:" + "|".join(PP.STOP_WORDS) + ")($|[^\\pL\\pN_])"
    return f"(length({v}) >= 3 AND NOT regexp_matches({norm(v)}, {q(stop)}))"


def upper_runs_sql() -> str:
    parts = []
    for pat in (role_re(), upper_run_re()):
        parts.append(f"""SELECT doc_id, CAST(start AS INTEGER) AS start,
       regexp_replace(split_part(p, '{SC}', 1), '{NM}', '', 'g') AS value
FROM ({_name_matches('text', pat, 'doc_id', 'documents')}) WHERE idx > 1""")
    u = " UNION ALL ".join(parts)
    return f"SELECT doc_id, start, value FROM ({u}) WHERE {_keep('value')}"



def trusted_re() -> str:
    from ..functions import patterns as PP
    words = "|".join(w.replace(" ", f"[{WS}]{NM}") for w in PP.TRUSTED_CONTEXT_WORDS)
    pre = f"(?i:(?:^|{NM})(?:{words}){_WSM}*(?:[:\\-]{NM})?{_WSM}+)"
    return f"({pre})((?i:{_words_re()}))($|{_NONWORD})"


def _candidates(table: str, id_col: str, col: str) -> str:
    """(doc_id, start, value, trusted) candidates that pass D15/D17."""
    parts = []
    for kind, pat in (("suspect", role_re()), ("suspect", upper_run_re()), ("trusted", trusted_re())):
        parts.append(f"""SELECT doc_id, CAST(start AS INTEGER) AS start, '{kind}' AS kind,
       regexp_replace(split_part(p, '{SC}', 1), '{NM}', '', 'g') AS value
FROM ({_name_matches(col, pat, id_col, table)}) WHERE idx > 1""")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {_keep('value')}"


def _approvable(table: str, id_col: str, col: str) -> str:
    """Suspects of >= 2 words not trusted in their own text."""
    c = _candidates(table, id_col, col)
    nwords = f"len(regexp_split_to_array({strip('s.value')}, {q('[' + WS + ']+')}))"
    return f"""
WITH c AS ({c})
SELECT s.doc_id, s.start, s.value FROM c s
WHERE s.kind = 'suspect' AND {nwords} >= 2
  AND NOT EXISTS (SELECT 1 FROM c t WHERE t.kind = 'trusted' AND t.doc_id = s.doc_id AND t.value = s.value)"""


def oracle_queries() -> dict[str, str]:
    """Query name -> DuckDB SQL (the correctness oracle)."""
    out = _core_queries()
    out["classify_columns"] = classify_sql()
    out["audit_email"] = audit_email_sql()
    out["fragment_text"] = fragment_sql()
    out["find_chassi"] = find_chassi_sql()
    src = cpf_source("o_custkey")
    out["mask_orders_cpf"] = f"SELECT *, {surrogate('CPF', src)} AS cpf FROM orders"
    strings = ["nr_documento", "contato", "veiculo", "posicao", "quando", "c_mktsegment"]
    out["classify_identities"] = classify_sql({"customer": strings}, {"customer": f"({identity_sql()})"})
    out["mask_shapes"] = mask_shapes_sql()
    out["audit_identities"] = f"""
WITH o AS (SELECT c_custkey AS k, {named_person('c_custkey')} AS person FROM customer WHERE c_custkey % 10 <> 0)
SELECT 'cells_evaluated' AS metric, COUNT(*) AS value FROM o
UNION ALL SELECT 'cells_changed', COUNT(*) FROM o
UNION ALL SELECT 'span_substitutions', 2 * COUNT(*) FROM o
UNION ALL SELECT 'propagated_substitutions', 0
UNION ALL SELECT 'persons_protected', COUNT(DISTINCT upper(person)) FROM o
UNION ALL SELECT 'documents_protected', COUNT(DISTINCT k) FROM o"""
    person = ("titular", "apelido", "relato", "local", "c_mktsegment")
    out["classify_names"] = classify_sql({"customer": list(person)}, {"customer": (
        f"(SELECT {named_person('c_custkey')} AS titular, {pick(S.FIRST_NAMES, 'c_custkey')} AS apelido, "
        f"{named_person('c_custkey')} || ' comprou ' || c_custkey || ' itens na loja' AS relato, "
        f"'rua ' || c_custkey AS local, c_mktsegment FROM customer)")}, names=True)
    out["lexicon_names"] = name_runs_sql(
        f"SELECT doc_id, coalesce(text, '') || ' Relato de ' || {named_person('doc_id')} || ', e ' || "
        f"upper({named_person('(doc_id * 5 + 1)')}) || ' (presente).' AS text FROM documents", 2)
    out["trim_candidates"] = trim_sql()
    out["mask_identities"] = (
        f"SELECT c_custkey, {surrogate('CPF', 'nr_documento')} AS nr_documento, {surrogate('EMAIL', 'contato')} AS contato, "
        f"{surrogate('PLATE', 'veiculo')} AS veiculo, quando, c_mktsegment, c_acctbal FROM ({identity_sql()})")
    # classification decides IGNORAR for every customer column (checked by
    # classify_columns' own oracle), so the masked table equals the input
    out["mask_customer"] = "SELECT * FROM customer"
    from .registry import TABLES
    parts = [f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in TABLES]
    out["table_counts"] = ("WITH per AS (" + " UNION ALL ".join(parts) + ") "
                           "SELECT * FROM per UNION ALL SELECT '*', SUM(n_rows) FROM per")
    out["upper_runs"] = upper_runs_sql()
    out["name_trusted_anti"] = _approvable("documents", "doc_id", "text")
    docs = _approvable("documents", "doc_id", "text")
    conv = _approvable("(SELECT row_number() OVER () AS rid, text FROM conversations)", "rid", "text")
    out["candidate_terms"] = (f"SELECT DISTINCT {upper('value')} AS term_key FROM ({docs}) "
                              f"UNION SELECT DISTINCT {upper('value')} AS term_key FROM ({conv})")
    term = upper("value")
    out["name_verdict_docs"] = (
        f"SELECT doc_id, string_agg(term, '|' ORDER BY term) AS terms FROM (SELECT DISTINCT doc_id, {term} AS term FROM ({docs})) "
        "WHERE length(term) % 2 = 0 GROUP BY doc_id")
    out["mask_collisions"] = ("SELECT 'CPF' AS type, COUNT(DISTINCT o_orderkey) AS n_keys, COUNT(DISTINCT o_orderkey) AS n_masks "
                              "FROM orders UNION ALL SELECT 'EMAIL', COUNT(DISTINCT o_orderkey), COUNT(DISTINCT o_orderkey) FROM orders")
    # the registered query's stand-in adjudicator approves 2-4 alphabetic words
    out["name_verdict_semi"] = (f"SELECT term_key FROM ({out['candidate_terms']}) "
                                f"WHERE regexp_full_match(term_key, {q('\\pL+(?:[' + WS + ']+\\pL+){1,3}')})")
    return out
