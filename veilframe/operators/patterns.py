"""The catalogue of identifier patterns.

Patterns are tried together and ranked only to settle ties between spans of
one start and length: keyword first, then fixed prefix, then checksum, then
the order of the catalogue.
"""

from __future__ import annotations

from dataclasses import dataclass

# Ignore case in every script; \\d, \\s, \\w and \\b follow Unicode.
FLAGS = "(?iuU)"


@dataclass(frozen=True)
class Pattern:
    ty: str
    regex: str
    family: str
    rank: int = 0
    # What a text must contain for the pattern to be worth trying: a kind of
    # characters, and one of some words in upper case.
    needs: str = "digit"
    words: tuple[str, ...] = ()
    # What the shape of every match contains: 0 for a digit, A for a letter; see detect.py.
    shape: str = ""
    luhn: bool = False
    score: float = 1.0
    flags: str = FLAGS

    @property
    def compiled(self) -> str:
        return self.flags + self.regex


# --- Fixed values: the identifier formats ------------------------------------
_PREFIX = (
    r"(?:г\.|город|пос\.|поселок|посёлок|с\.|село|ст-ца|станица|д\.|деревня|обл\.|область"
    r"|р-н|район|мкр\.|микрорайон|ул\.|улица|пер\.|переулок|пр-кт|проспект|бул\.|бульвар"
    r"|наб\.|набережная)"
)
_PART = (
    r"(?:г\.|город|пос\.|поселок|посёлок|с\.|село|д\.|деревня|дом|ул\.|улица|пер\.|переулок"
    r"|пр-кт|проспект|бул\.|бульвар|наб\.|набережная|кв\.|квартира|корп\.|корпус|стр\."
    r"|строение|обл\.|область|р-н|район|мкр\.|микрорайон)"
)
_PLATE = "[АВЕКМНОРСТУХA-Z]"

RU_FORMATS = {
    "PASSPORT_RU": r"(?=\d)\b\d{2}\s*\d{2}\s*(?:№|N|-|номер)?\s*\d{6}\b",
    "INTL_PASSPORT_RU": r"(?=\d)\b\d{2}\s*\d{7}\b",
    "INN_RU": (
        r"(?=\d)(?:(?<=ИНН\s)|(?<=ИНН:\s)|(?<=ИНН:)|(?<=ИНН\s№\s)|(?<=ИНН\s№)|(?<=ИНН№)"
        r"|(?<=INN\s)|(?<=INN:\s)|(?<=INN:))\d{10}(?:\d{2})?\b"
    ),
    "SNILS_RU": (
        r"(?=\d)(?:(?:(?<=\bСНИЛС\s)|(?<=\bСНИЛС:\s)|(?<=\bСНИЛС:))\d{11}\b"
        r"|\b\d{3}[-\s.]?\d{3}[-\s.]?\d{3}[-\s.]?\d{2}\b)"
    ),
    "OGRN_RU": r"(?=\d)\b\d{13}(?:\d{2})?\b",
    "KPP_RU": r"(?=\d)(?:(?<=КПП\s)|(?<=КПП:\s)|(?<=КПП:))\d{9}\b",
    "BANK_ACCOUNT_RU": r"(?=4)\b4\d{19}\b",
    "BIK_RU": r"(?=0)\b04\d{7}\b",
    "CREDIT_CARD": r"(?=\d)\b(?:\d{4}[-\s]?){3}\d{4,7}\b",
    "PHONE_RU": (
        r"(?=[+8])(?:(?<=\s)|(?<=\b)|^)(?:\+7|8)[-\s]?\(?\d{3}\)?[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b"
    ),
    "DRIVER_LICENSE_RU": r"(?=\d)\b\d{2}\s*(?:\d{2}|[А-ЯA-Z]{2})\s*\d{6}\b",
    # Digits that follow the word are always found with the word itself.
    "OMS_RU": r"(?:ОМС|полис|страхов)[:\s№]*?\d{16}",
    "ADDRESS_RU": (
        rf"\b(?:{_PREFIX}\s+[А-ЯЁа-яёA-Za-z0-9\-\.]+"
        rf"(?:\s*,\s*{_PART}?\s*[А-ЯЁа-яёA-Za-z0-9\-\.]+)+)"
    ),
    "VEHICLE_PRIVATE_RU": rf"\b{_PLATE}\s*\d{{3}}\s*{_PLATE}{{2}}\s*\d{{2,3}}\b",
    "VEHICLE_TAXI_BUS_RU": rf"\b{_PLATE}{{2}}\s*\d{{3}}\s*\d{{2,3}}\b",
    "VEHICLE_TRAILER_RU": rf"\b{_PLATE}{{2}}\s*\d{{4}}\s*\d{{2,3}}\b",
    "VEHICLE_MOTO_RU": rf"(?=\d)\b\d{{4}}\s*{_PLATE}{{2}}\s*\d{{2,3}}\b",
    "VIN": r"\b[A-HJ-NPR-Z0-9]{17}\b",
}

IN_FORMATS = {
    "AADHAAR_IN": r"(?=\d)\b\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "PAN_IN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "VOTER_ID_IN": r"\b[A-Z]{3}\d{7}\b",
    "PASSPORT_IN": r"\b[A-Z]\d{7}\b",
    "GSTIN_IN": r"(?=\d)\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",
    "DRIVING_LICENSE_IN": r"\b[A-Z]{2}[-\s]?\d{2}[-\s]?\d{4}[-\s]?\d{7}\b",
    "PHONE_IN": r"\b(?:\+91|91)?[-\s]?\d{10}\b",
    "IFSC_IN": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "VEHICLE_STANDARD_IN": r"\b[A-Z]{2}[-\s]?\d{1,2}[-\s]?[A-Z]{1,3}[-\s]?\d{4}\b",
    "VEHICLE_BH_IN": r"(?=\d)\b\d{2}[-\s]?BH[-\s]?\d{4}[-\s]?[A-Z]{1,2}\b",
}
# -----------------------------------------------------------------------------

# A run of local-part characters is tried once, from its start. Its classes name
# both cases, so it needs no flags.
EMAIL_FORMAT = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"
)

_KEYWORD = ("INN_RU", "SNILS_RU", "KPP_RU", "OMS_RU")
_FIXED_PREFIX = ("BANK_ACCOUNT_RU", "BIK_RU")
_CHECKSUM = ("CREDIT_CARD",)
_SHAPES = {
    "PASSPORT_RU": "0" * 6, "INTL_PASSPORT_RU": "0" * 9, "INN_RU": "0" * 10, "SNILS_RU": "0" * 11,
    "OGRN_RU": "0" * 13, "KPP_RU": "0" * 9, "BANK_ACCOUNT_RU": "0" * 20, "BIK_RU": "0" * 9,
    "CREDIT_CARD": "0" * 16, "PHONE_RU": "0" * 11, "DRIVER_LICENSE_RU": "0" * 6, "OMS_RU": "0" * 16,
    "VEHICLE_PRIVATE_RU": "A000AA00", "VEHICLE_TAXI_BUS_RU": "AA00000", "VEHICLE_TRAILER_RU": "AA000000",
    "VEHICLE_MOTO_RU": "0000AA00", "AADHAAR_IN": "0" * 12, "PAN_IN": "AAAAA0000A", "VOTER_ID_IN": "AAA0000000",
    "PASSPORT_IN": "A0000000", "GSTIN_IN": "00AAAAA0000A", "DRIVING_LICENSE_IN": "AA" + "0" * 13,
    "PHONE_IN": "0" * 10, "IFSC_IN": "AAAA0", "VEHICLE_STANDARD_IN": "A0000", "VEHICLE_BH_IN": "00AA0000A",
}
_NEEDS = {
    **dict.fromkeys(RU_FORMATS | IN_FORMATS, "3 digits"),
    "IFSC_IN": "digit",
    "ADDRESS_RU": "address",
    "VIN": "long word",
}
_WORDS = {
    "INN_RU": ("ИНН", "INN"),
    "KPP_RU": ("КПП",),
    "OMS_RU": ("ОМС", "ПОЛИС", "СТРАХОВ"),
    "BIK_RU": ("04",),
    "ADDRESS_RU": tuple(w.replace("\\", "").upper() for w in _PREFIX[3:-1].split("|")),
}


def _rank(ty: str, position: int) -> int:
    for tier, members in enumerate((_KEYWORD, _FIXED_PREFIX, _CHECKSUM)):
        if ty in members:
            return tier * 100 + position
    return 300 + position


def _catalogue(formats: dict[str, str], family: str) -> list[Pattern]:
    return [
        Pattern(
            ty,
            regex,
            family,
            rank=_rank(ty, i),
            needs=_NEEDS[ty],
            words=_WORDS.get(ty, ()),
            shape=_SHAPES.get(ty, ""),
            luhn=ty in _CHECKSUM,
        )
        for i, (ty, regex) in enumerate(formats.items())
    ]


RU = _catalogue(RU_FORMATS, "ru")
IN = _catalogue(IN_FORMATS, "en")
FIRST_PASS = {"ru": RU, "en": IN}
SECOND_PASS = [
    Pattern("EMAIL_ADDRESS", EMAIL_FORMAT, "any", rank=0, needs="at", flags=""),
    Pattern("CREDIT_CARD", RU_FORMATS["CREDIT_CARD"], "any", rank=1, needs="3 digits", shape="0" * 16, luhn=True),
]
BY_TYPE = {p.ty: p for p in RU + IN + SECOND_PASS[:1]}

FIRST_THRESHOLD = 0.9
SECOND_THRESHOLD = 0.6
