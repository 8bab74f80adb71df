"""Detector patterns and word lists.

Everything in the "fixed values" blocks must stay equal to the behaviour we
match: the shapes of the identifiers, the context words and the stop
vocabulary.  They are plain data; the logic that uses them lives in
``sombra.operators``.

All patterns run on the JVM (``java.util.regex``).  ``JAVA`` adds the flags
that make Java behave like a Unicode ``str`` regex: ``(?U)`` for Unicode
``\\d \\s \\w \\b`` and ``(?d)`` so ``.`` stops only at ``\\n``.
"""

from __future__ import annotations

from dataclasses import dataclass

UNICODE = "(?U)"
UNICODE_NOCASE = "(?iuU)"
UNIX_LINES = "(?d)"

# ----------------------------------------------------------------------------
# Identifier shapes (detectors D1-D10).
# ----------------------------------------------------------------------------
CPF = r"(?<!\d)(?:\d[-.\s_/*]{0,4}){10}\d(?!\d)"
IP = r"(?<!\d)(?:\d{1,3}[_.\-\s]+){3}\d{1,3}(?!\d)"
RG = r"(?<!\d)(?:\d[-.\s_/*]{0,4}){6,9}[0-9Xx](?!\d)"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PLATE = (r"(?<![A-Za-z])(?:[A-Za-z][-.\s_]*){3}\d[-.\s_]*[A-Za-z0-9][-.\s_]*\d"
         r"[-.\s_]*\d(?![A-Za-z0-9])")
PHONE = (r"(?<!\d)(?:\+?55[-.\s_]*)?(?:\(?[0]?\d{2}\)?[-.\s_]*)?(?:9[-.\s_]*)?"
         r"\d{4,5}[-.\s_]*\d{4}(?!\d)")
CHASSI = r"(?<![A-Za-z0-9])(?:[A-HJ-NPR-Z0-9][\-\s]*){16}[A-HJ-NPR-Z0-9](?![A-Za-z0-9])"
DATE_TIME = (r"(?<!\d)\d{1,4}[/.\-\\]\d{1,2}[/.\-\\]\d{2,4}"
             r"(?:[-.\s_]+\d{1,2}[:h]\d{1,2}(?::\d{1,2})?)?(?!\d)")
COORD = r"(?<!\d)-?\d{1,3}[.,]\d{3,}[^A-Za-z0-9]+-?\d{1,3}[.,]\d{3,}(?!\d)"
COORD_SINGLE = r"(?<!\d)-?\d{1,3}[.,]\d{3,}(?!\d)"

# Amounts of money (own design): a sample's amounts are not its coordinates.
MONEY = r"(?:R\$|US\$|\$|€)\s*[0-9][0-9.,]*|[0-9][0-9.,]*\s*(?:mil\s+)?(?:reais|real|euros?)\b"

# Tags whose pattern ignores case.
NOCASE_TAGS = ("CHASSI", "DATE_TIME")

# ----------------------------------------------------------------------------
# Person-name contexts (D11-D13), ignore case except the run.
# ----------------------------------------------------------------------------
TRUSTED_CONTEXT_WORDS = ["corpo de", "cadáver de", "cadaver de"]
ROLE_CONTEXT_WORDS = [
    "nome", "cliente", "paciente", "sr", "sra", "dr", "dra", "vítima", "vitima",
    "autor", "perito", "legista", "motorista", "condutor", "testemunha",
    "delegado", "investigador", "agente", "suspeito",
]
NAME_WORDS = r"[A-ZÀ-Ÿa-zà-ÿ]{2,20}(?:\s+[A-ZÀ-Ÿa-zà-ÿ]{2,20}){1,5}"
ROLE_FILLER = r"(?:.*?[:\-.)])?"
UPPER_RUN = r"\b[A-ZÀ-Ÿ]{2,}(?:\s+(?:DE|DA|DO|DOS|DAS|E|DI)?\s*[A-ZÀ-Ÿ]{2,}){1,5}\b"

# Particles inside a name, words a candidate may not begin with, and verbs that
# end one (own lists, for candidates trimmed without a model).
NAME_PARTICLES = ["DE", "DA", "DO", "DOS", "DAS", "E", "DI", "DEL"]
LEADING_WORDS = [
    "a", "o", "as", "os", "um", "uma", "uns", "umas", "de", "da", "do", "das", "dos",
    "em", "na", "no", "nas", "nos", "ao", "aos", "à", "às", "por", "pela", "pelo", "pelas",
    "pelos", "para", "com", "sem", "sob", "sobre", "entre", "até", "desde", "contra",
    "este", "esta", "esse", "essa", "aquele", "aquela", "seu", "sua", "meu", "minha",
]
AUXILIARIES = [
    "é", "são", "foi", "foram", "era", "eram", "está", "estão", "estava", "estavam",
    "tem", "têm", "tinha", "tinham", "ser", "estar", "ter", "há", "havia", "vai", "vão",
]

# ----------------------------------------------------------------------------
# Stop vocabulary (D15).  A name candidate whose normal form
# contains any of these words is dropped.
# ----------------------------------------------------------------------------
STOP_WORDS = [
    "rua", "avenida", "av", "travessa", "trav", "praca", "alameda", "rodovia",
    "bairro", "lote", "quadra", "condominio", "edificio", "bloco", "apartamento",
    "km", "br", "centro", "jardim", "parque", "vila",
    "sistema", "relatorio", "projeto", "arquivo", "anexo", "dados", "usuario",
    "senha", "protocolo", "veiculo", "carro", "moto", "motocicleta", "caminhao",
    "bicicleta", "placa", "chassi", "renavam",
    "fatal", "como", "sendo", "passageira", "passageiro", "capotou", "capoti",
    "data", "joaquim", "tavora", "carlopolis", "irati", "exames", "historico",
    "raca", "cor", "estatura", "talhe", "conclusao",
    "fratura", "fechada", "aberta", "sangue", "escoria", "escoriacao", "parede",
    "espessada", "massa", "encefalica", "dente", "arcada", "muscular",
    "subjacente", "lateral", "terco", "pleura", "aparente", "rosto", "face",
    "externa", "extensa",
    "acidente", "transito", "hospital", "lesao", "ferimento", "obito", "entrada",
    "boletim", "ocorrencia", "equipe", "saude", "via", "publica", "evento",
    "automotor", "automovel", "passeio", "energia", "impacto", "colisao",
    "autoxauto", "atropelamento",
    "homem", "mulher", "adulto", "adulta", "crianca", "idoso", "indigente",
    "desconhecido", "individuo", "sexo", "feminino", "masculino", "menino",
    "menina", "ignorado", "ignorada", "natimorto", "feto",
    "condutor", "motorista", "vitima", "autor", "paciente", "perito", "legista",
    "medico", "policial", "socorrista", "agente", "delegado", "investigador",
    "cadaver", "corpo", "falecido", "falecida", "suspeito", "testemunha",
]

# ----------------------------------------------------------------------------
# Column classifier.
# ----------------------------------------------------------------------------
NULL_TOKENS = ["NÃO CONSTA", "NULL", "NONE", "", "PREJUDICADO"]
SAMPLE_SIZE = 50
GPS_SHARE = 0.5
NAME_HINT_WEIGHT = 0.4
PROSE_WEIGHT = 0.8
MIN_CONFIDENCE = 0.6
FULL_MATCH_SHARE = 0.8
PROSE_MEAN_WORDS = 3
PROSE_PUNCT = r"[,.!?]\s+[A-Z]"
# column-name part -> tag it hints at
NAME_HINTS = {"cpf": "CPF", "rg": "RG", "identidade": "RG", "email": "EMAIL", "placa": "PLATE"}
IGNORE_NAME_PARTS = [
    "cidade", "estado", "pais", "bairro", "cep", "status", "tipo", "marca", "cor",
    "data", "hora", "latitude", "longitude", "coord",
]
# classifier tag -> column policy
TAG_TO_POLICY = {"PLATE": "PLACA", "DATE_TIME": "IGNORAR"}

# Markup shield (P12) and the adjudication floor.
TAG_PATTERN = r"<[^>]+>"
MIN_NAME_CHARS = 3
MIN_NAME_WORDS = 2

# Coordinate jitter (M5).  Numbers with at least this many decimals move by at
# most this many degrees.  The reference needs 4 decimals to jitter; we use 3
# so every detected coordinate changes.
JITTER_NUMBER = r"-?\d{1,3}[.,]\d{3,}"
JITTER_MICRODEG = 3000


@dataclass(frozen=True)
class Detector:
    tag: str
    pattern: str          # Java regex, flags included
    prio: int             # tie order: lower wins at equal start and length


def _java(tag: str, pattern: str) -> str:
    return (UNICODE_NOCASE if tag in NOCASE_TAGS else UNICODE) + pattern


# Tie order for spans with the same start and length.
SPAN_ORDER = ["CPF", "IP", "RG", "EMAIL", "PLATE", "PHONE", "CHASSI", "COORD",
              "COORD_SINGLE", "PER_TRUSTED", "PER"]
_RAW = {"CPF": CPF, "IP": IP, "RG": RG, "EMAIL": EMAIL, "PLATE": PLATE,
        "PHONE": PHONE, "CHASSI": CHASSI, "DATE_TIME": DATE_TIME,
        "COORD": COORD, "COORD_SINGLE": COORD_SINGLE}
# Java-only speedup: a separator run before the next VIN character can never
# give back characters usefully, so it is matched possessively (same matches).
_JAVA_TUNING = {"CHASSI": (r"[\-\s]*)", r"[\-\s]*+)")}


def _tuned(tag: str, pattern: str) -> str:
    if tag in _JAVA_TUNING:
        old, new = _JAVA_TUNING[tag]
        return pattern.replace(old, new)
    return pattern


DETECTORS = {t: Detector(t, _java(t, _tuned(t, p)), SPAN_ORDER.index(t) if t in SPAN_ORDER else 99)
             for t, p in _RAW.items()}

# Strict profile: a VIN needs a digit, upper-case runs use
# Unicode upper-case letters only.
STRICT_UPPER_RUN = r"\b\p{Lu}{2,}(?:\s+(?:DE|DA|DO|DOS|DAS|E|DI)?\s*\p{Lu}{2,}){1,5}\b"


def _alternation(words: list[str]) -> str:
    return "|".join(words)


def _first_letters(words: list[str]) -> str:
    """Java-only speedup: a look-ahead on the possible first letters lets the
    engine skip every other start position at once (same matches)."""
    return "(?=[" + "".join(sorted({w[0] for w in words})) + "])"


def trusted_context_pattern() -> str:
    """Group 1 = the context up to the name, group 2 = the name."""
    return (UNICODE_NOCASE
            + r"(" + _first_letters(TRUSTED_CONTEXT_WORDS)
            + r"\b(?:" + _alternation(TRUSTED_CONTEXT_WORDS) + r")\s*[:\-]?\s+)"
            + "(" + NAME_WORDS + r")\b")


def role_context_pattern() -> str:
    """Group 1 = role word and filler, group 2 = the name."""
    return (UNICODE_NOCASE + UNIX_LINES
            + r"(" + _first_letters(ROLE_CONTEXT_WORDS)
            + r"\b(?:" + _alternation(ROLE_CONTEXT_WORDS) + r")\b" + ROLE_FILLER + r"\s*)"
            + "(" + NAME_WORDS + r")\b")


def upper_run_pattern(strict: bool = False) -> str:
    return UNICODE + (STRICT_UPPER_RUN if strict else UPPER_RUN)


def stop_words_pattern() -> str:
    return UNICODE_NOCASE + r"\b(?:" + _alternation(STOP_WORDS) + r")\b"
