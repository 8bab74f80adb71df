"""Shape-preserving, keyed surrogates.

A surrogate is a pure expression of (key, type family, normal form of the
value): the same real value always gets the same mask, in any table, column,
partition or run with the same key, so joins on masked keys still work (J6)
and no lookup table has to be shipped around.

Digits and letters are taken from successive bytes of the HMAC digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .hashing import MaskKey, hex_byte, hex_word, hmac_hex
from .expr import let
from .text import MARK_CLOSE, MARK_OPEN, clean_value, normalize

# Our own invented name and word lists (not tied to any library's data).
FIRST_NAMES = [
    "ADRIANA", "ALICE", "AMANDA", "ANDRE", "BEATRIZ", "BRUNO", "CAIO", "CAMILA",
    "CARLA", "CLARA", "DANIEL", "DEBORA", "DIEGO", "EDUARDO", "ELISA", "FABIO",
    "FERNANDA", "GABRIEL", "GUSTAVO", "HELENA", "IGOR", "ISABEL", "JULIA",
    "LARISSA", "LEANDRO", "LIVIA", "LUCAS", "MARCOS", "MARINA", "MATEUS",
    "MIGUEL", "NATALIA", "OTAVIO", "PAULA", "PEDRO", "RAFAEL", "RENATA",
    "RODRIGO", "SABRINA", "SAMUEL", "SILVIA", "TATIANA", "THIAGO", "VALERIA",
    "VINICIUS", "VITORIA", "WAGNER", "YASMIN",
]
LAST_NAMES = [
    "ALMEIDA", "ALVES", "ANDRADE", "ARAUJO", "BARBOSA", "BARROS", "BATISTA",
    "CAMPOS", "CARDOSO", "CARVALHO", "CASTRO", "CORREIA", "COSTA", "DIAS",
    "DUARTE", "FARIAS", "FERREIRA", "FREITAS", "GOMES", "LIMA", "LOPES",
    "MACHADO", "MARTINS", "MELO", "MENDES", "MONTEIRO", "MOREIRA", "NASCIMENTO",
    "NUNES", "OLIVEIRA", "PEREIRA", "PINTO", "RAMOS", "REIS", "RIBEIRO",
    "ROCHA", "RODRIGUES", "SANTANA", "SANTOS", "SILVA", "SOUZA", "TEIXEIRA",
    "VIANA", "VIEIRA", "XAVIER", "MOURA", "CUNHA", "PIRES",
]
WORDS = [
    "ACORDE", "BALSA", "CANTO", "DUNA", "ESTRELA", "FAROL", "GALHO", "HORTA",
    "ILHA", "JANELA", "LAGO", "MONTE", "NUVEM", "ONDA", "PEDRA", "QUINTAL",
    "RIACHO", "SERRA", "TRILHA", "URZE", "VALE", "VENTO", "BRISA", "CORAL",
    "FLORESTA", "GRUTA", "MARE", "PRAIA", "RAIZ", "SELVA", "TERRA", "AURORA",
]
# Fixed value: the 33-character VIN alphabet (no I, O, Q).
VIN_ALPHABET = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EMAIL_DOMAIN = "example.com"

# Type -> family: members of one family share seeds, so a name masked in a
# NOME_SOLTO column and the same name in free text get the same surrogate.
FAMILY = {
    "PER": "PER", "NOME_SOLTO": "PER", "PLATE": "PLATE", "PLACA": "PLATE",
    "COORD": "COORD", "COORD_SINGLE": "COORD", "CPF": "CPF", "RG": "RG",
    "EMAIL": "EMAIL", "PHONE": "PHONE", "IP": "IP", "CHASSI": "CHASSI",
}
MASKABLE_TYPES = list(FAMILY)


def family(tag: str) -> str:
    return FAMILY.get(tag, "WORD")


def canonical(norm: Column, fam: str) -> Column:
    """Family-specific identity of a normalised value (design, SURVEY M4)."""
    if fam in ("CPF", "RG", "PHONE", "PLATE", "CHASSI"):
        return F.regexp_replace(norm, "[^0-9A-Z]", "")
    if fam == "IP":
        return F.regexp_replace(norm, "[^0-9]+", ".")
    if fam == "PER":
        return F.regexp_replace(norm, r"(?U)\s+", " ")
    return norm


def digest(value: Column, fam: str, key: MaskKey, cleaned: bool = False) -> Column:
    v = value if cleaned else clean_value(value)
    return hmac_hex(F.concat(F.lit(fam + ":"), canonical(normalize(v), fam)), key)


def _pick(words: list[str], idx: Column) -> Column:
    arr = F.array(*[F.lit(w) for w in words])
    return F.element_at(arr, (idx % len(words)) + 1)


# A fake reads digest bytes through an accessor ``byte(k) -> Column`` (k may be
# a Column).  Top-level columns read them straight from the hex digest (plain
# expressions, whole-stage codegen); spans inside a lambda decode the digest
# once into an int array and index it.

def hex_bytes(h: Column):
    return lambda k: hex_byte(h, k)


def array_bytes(b: Column):
    return lambda k: F.element_at(b, (F.lit(k) if not isinstance(k, Column) else k) + 1)


def byte_array(h: Column) -> Column:
    """The 32 digest bytes as array<int>, decoded once: five 7-byte chunks are
    parsed as integers and the bytes shifted out of them.  The digest is bound
    first: each chunk would compute it again."""
    def chunks(d: Column) -> Column:
        return F.array(*[F.conv(F.rpad(F.substring(d, 14 * j + 1, 14), 14, "0"), 16, 10).cast("bigint")
                         for j in range(5)])

    def split(c: Column) -> Column:
        return F.array(*[F.shiftright(F.element_at(c, k // 7 + 1), 8 * (6 - k % 7))
                         .bitwiseAND(F.lit(255)).cast("int") for k in range(32)])

    return let(h, lambda d: let(chunks(d), split))


def _word(byte, k) -> Column:
    return byte(k) * 256 + byte(k + 1 if not isinstance(k, Column) else k + F.lit(1))


def _digit(byte, k: int) -> Column:
    return (byte(k) % 10).cast("string")


def _letter(byte, k: int) -> Column:
    return F.substr(F.lit(LETTERS), (byte(k) % 26) + 1, F.lit(1))


def _check_digit(total: Column) -> Column:
    """mod-11 check digit: 0 when the remainder is 0 or 1, else 11 - r."""
    return ((F.lit(11) - total % 11) % 11) % 10


def cpf_checks(e: list[Column]) -> tuple[Column, Column]:
    """The two check digits of nine payload digits."""
    c1 = _check_digit(sum((e[i] * (10 - i) for i in range(9)), F.lit(0)))
    c2 = _check_digit(sum((e[i] * (11 - i) for i in range(9)), F.lit(0)) + c1 * 2)
    return c1, c2


def valid_cpf(canon: Column) -> Column:
    """Eleven digits of which the last two check the others."""
    c1, c2 = cpf_checks([F.substring(canon, i + 1, 1).cast("int") for i in range(9)])
    return canon.rlike("^[0-9]{11}$") & (F.substring(canon, 10, 2) == F.concat(c1.cast("string"), c2.cast("string")))


def fake_cpf(byte) -> Column:
    """M7: formatted CPF with valid check digits."""
    e = [byte(k) % 10 for k in range(9)]
    c1, c2 = cpf_checks(e)
    txt = [x.cast("string") for x in e]
    return F.concat(txt[0], txt[1], txt[2], F.lit("."), txt[3], txt[4], txt[5], F.lit("."),
                    txt[6], txt[7], txt[8], F.lit("-"), c1.cast("string"), c2.cast("string"))


CPF_LEFT, CPF_RIGHT = 10 ** 4, 10 ** 5      # halves of the nine payload digits


def permuted_cpf(canon: Column, key: MaskKey) -> Column:
    """M7: the nine payload digits of a valid CPF moved by a keyed permutation
    (four Feistel rounds, halves added modulo their size), so different CPFs
    never share a mask; check digits follow.  Numbers whose check digits are
    wrong take theirs from the digest (10^9 masks, which can collide)."""
    def turn(r: int, x: Column, size: int) -> Column:
        h = hmac_hex(F.concat(F.lit(f"CPF{r}:"), x.cast("string")), key)
        return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") % size

    # every half is bound once; nothing is copied into the next round
    def first_right(left: Column) -> Column:
        return let((F.substring(canon, 5, 5).cast("bigint") + turn(1, left, CPF_RIGHT)) % CPF_RIGHT,
                   lambda right: let((left + turn(2, right, CPF_LEFT)) % CPF_LEFT,
                                     lambda last: last_right(last, right)))

    def last_right(left: Column, right: Column) -> Column:
        right = (right + turn(3, left, CPF_RIGHT)) % CPF_RIGHT
        digits = F.concat(F.lpad(left.cast("string"), 4, "0"), F.lpad(right.cast("string"), 5, "0"))
        return let(digits, lambda d: fake_cpf(lambda k: F.substring(d, k + 1, 1).cast("int")))

    start = F.substring(canon, 1, 4).cast("bigint") + turn(0, F.substring(canon, 5, 5).cast("bigint"), CPF_LEFT)
    return let(start % CPF_LEFT, first_right)


def fake_rg(byte) -> Column:
    """M8: ``##.###.###-#``."""
    d = [_digit(byte, k) for k in range(9)]
    return F.concat(d[0], d[1], F.lit("."), d[2], d[3], d[4], F.lit("."),
                    d[5], d[6], d[7], F.lit("-"), d[8])


def fake_plate(byte) -> Column:
    """M9: old ``LLL-NNNN`` or Mercosur ``LLLNLNN`` plate."""
    l1, l2, l3, l4 = (_letter(byte, k) for k in (0, 1, 2, 3))
    n = [_digit(byte, k) for k in (4, 5, 6, 7)]
    old = F.concat(l1, l2, l3, F.lit("-"), n[0], n[1], n[2], n[3])
    new = F.concat(l1, l2, l3, n[0], l4, n[1], n[2])
    return F.when(byte(8) % 2 == 0, old).otherwise(new)


def fake_person(byte, real_norm: Column | None = None) -> Column:
    """M6: ``FIRST LAST``; if the surname equals the real one, take the next."""
    first = _pick(FIRST_NAMES, _word(byte, 0))
    last_idx = _word(byte, 2)
    last = _pick(LAST_NAMES, last_idx)
    if real_norm is not None:
        real_last = F.element_at(F.split(real_norm, r"(?U)\s+"), -1)
        last = F.when(last == real_last, _pick(LAST_NAMES, last_idx + 1)).otherwise(last)
    return F.concat(first, F.lit(" "), last)


def fake_email(byte) -> Column:
    """Lower-case ``first.last.<token>@example.com``; the token of 48
    digest bits keeps masks of different addresses apart."""
    first = _pick(FIRST_NAMES, _word(byte, 0))
    last = _pick(LAST_NAMES, _word(byte, 2))
    token = F.concat(*[F.lpad(F.hex(byte(k)), 2, "0") for k in range(4, 10)])
    return F.lower(F.concat(first, F.lit("."), last, F.lit("."), token, F.lit("@" + EMAIL_DOMAIN)))


def fake_phone(byte) -> Column:
    """``(AA) 9NNNN-NNNN`` with an area code 11..99."""
    area = (byte(0) % 89 + 11).cast("string")
    d = [_digit(byte, k) for k in range(1, 9)]
    return F.concat(F.lit("("), area, F.lit(") 9"), d[0], d[1], d[2], d[3],
                    F.lit("-"), d[4], d[5], d[6], d[7])


def fake_ipv4(byte) -> Column:
    """Four digest bytes."""
    return F.concat_ws(".", *[byte(k).cast("string") for k in range(4)])


def fake_vin(byte) -> Column:
    """17 draws from the VIN alphabet."""
    return F.concat(*[F.substr(F.lit(VIN_ALPHABET), byte(k) % 33 + 1, F.lit(1)) for k in range(17)])


def fake_word(byte) -> Column:
    """One upper-case word."""
    return _pick(WORDS, _word(byte, 0))


def jitter_coords(value: Column, byte) -> Column:
    """M5: every number with >= 3 decimals moves by at most 0.003, 6 decimals.

    The n-th number uses digest bytes 2n..2n+1, so two numbers in one value
    move independently.
    """
    marked = F.regexp_replace(value, "(?U)" + P.JITTER_NUMBER, MARK_OPEN + "$0" + MARK_CLOSE)
    parts = F.split(marked, MARK_OPEN)

    def jit(p: Column, i: Column) -> Column:
        num = F.substring_index(p, MARK_CLOSE, 1)
        tail = F.substring_index(p, MARK_CLOSE, -1)
        x = F.regexp_replace(num, ",", ".").cast("decimal(12,6)")
        micro = _word(byte, (i * 2) % 30) % (2 * P.JITTER_MICRODEG + 1) - P.JITTER_MICRODEG
        moved = (x + (micro.cast("decimal(12,0)") / F.lit(1000000))).cast("decimal(12,6)")
        return F.when(i == 0, p).otherwise(F.concat(moved.cast("string"), tail))

    return F.array_join(F.transform(parts, jit), "")


SHAPES = {"CPF": fake_cpf, "RG": fake_rg, "PLATE": fake_plate, "EMAIL": fake_email,
          "PHONE": fake_phone, "IP": fake_ipv4, "CHASSI": fake_vin}


def _fake(fam: str, byte, v: Column, key: MaskKey) -> Column:
    if fam == "CPF":
        return let(canonical(normalize(v), "CPF"), lambda c: F.when(
            valid_cpf(c), permuted_cpf(c, key)).otherwise(fake_cpf(byte)))
    if fam == "COORD":
        return jitter_coords(v, byte)
    if fam == "PER":
        return fake_person(byte, canonical(normalize(v), "PER"))
    return SHAPES.get(fam, fake_word)(byte)


def surrogate_for(tag: str, value: Column, key: MaskKey, cleaned: bool = False) -> Column:
    """Surrogate of ``value`` for a tag known when the plan is built.

    The cleaned value and the decoded digest bytes are bound once (``let``).
    """
    fam = family(tag)
    v0 = value if cleaned else clean_value(value)
    return let(v0, lambda v: let(byte_array(digest(v, fam, key, cleaned=True)),
                                 lambda b: _fake(fam, array_bytes(b), v, key)))


def _canonical_any(norm: Column, tag: Column) -> tuple[Column, Column]:
    """(family, canonical form) for a tag known only per row."""
    fam_expr = F.coalesce(F.element_at(F.create_map(*[a for t, f in FAMILY.items()
                                                      for a in (F.lit(t), F.lit(f))]), tag),
                          F.lit("WORD"))
    canon = (F.when(fam_expr.isin("CPF", "RG", "PHONE", "PLATE", "CHASSI"),
                    F.regexp_replace(norm, "[^0-9A-Z]", ""))
             .when(fam_expr == "IP", F.regexp_replace(norm, "[^0-9]+", "."))
             .when(fam_expr == "PER", F.regexp_replace(norm, r"(?U)\s+", " "))
             .otherwise(norm))
    return fam_expr, canon


def surrogate_any(tag: Column, value: Column, key: MaskKey, tags: list[str]) -> Column:
    """Surrogate for a tag known only per row (spans in free text): one digest
    per span, decoded once, then the shape of the span's type."""
    fams = sorted({family(t) for t in tags} | {"WORD"})

    def with_value(v: Column) -> Column:
        fam, canon = _canonical_any(normalize(v), tag)
        msg = F.concat(fam, F.lit(":"), canon)

        def with_bytes(b: Column) -> Column:
            byte = array_bytes(b)
            out = None
            for f in fams:
                branch = _fake(f, byte, v, key)
                out = F.when(fam == f, branch) if out is None else out.when(fam == f, branch)
            return out.otherwise(fake_word(byte))
        return let(byte_array(hmac_hex(msg, key)), with_bytes)

    return let(clean_value(value), with_value)


def add_surrogates(df, specs: dict, key: MaskKey, non_null: bool = False, keep_blank: bool = True):
    """Codegen path for top-level columns: ``specs`` maps an output column to
    (tag, input column).  The cleaned value and its digest are computed in one
    projection and the fakes read them in the next; Catalyst keeps the two
    apart because the digest is expensive and read many times, so no lambda
    (interpreted) evaluation is needed.  Blank inputs stay as they are, or, unless
    ``keep_blank``, get what :func:`surrogate_for` gives them.
    """
    from .text import is_blank
    tmp = {}
    for i, (out, (tag, src)) in enumerate(specs.items()):
        tmp[out] = (tag, src, f"__v{i}", f"__h{i}")
    # cleaned values first, digests over them next, fakes last
    staged = df.select(*[F.col(f"`{c}`") for c in df.columns],
                       *[clean_value(F.col(f"`{src}`")).alias(v) for _, (tag, src, v, h) in tmp.items()])
    staged = staged.select("*", *[digest(F.col(v), family(tag), key, cleaned=True).alias(h)
                                  for _, (tag, src, v, h) in tmp.items()])
    outs = {}
    for out, (tag, src, v, h) in tmp.items():
        fake = _fake(family(tag), hex_bytes(F.col(h)), F.col(v), key)
        if non_null:
            fake = F.coalesce(fake, F.lit(""))
        elif keep_blank:
            fake = F.when(is_blank(F.col(f"`{src}`")), F.col(f"`{src}`")).otherwise(fake)
        elif family(tag) != "IP":      # whose four null bytes are the empty text
            fake = F.when(F.col(f"`{src}`").isNotNull(), fake)
        outs[out] = fake
    cols = [outs[c].alias(c) if c in outs else F.col(f"`{c}`") for c in df.columns]
    cols += [outs[c].alias(c) for c in outs if c not in df.columns]
    return staged.select(*cols)
