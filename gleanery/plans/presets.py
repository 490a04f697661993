"""Vocabularies by kind of site that the generator looks things up in. Add to ``PRESETS`` for one's own."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


#: currency signs before a number, and codes after one
_BEFORE, _AFTER = r"/(?:{})\s*[,.\d]+/", r"/[,.\d]+\s*(?:{})/i"


@dataclass(frozen=True)
class Preset:
    """What names an image, a link or a rating, how prices are written, what a list's items must have, types of fields."""

    prices: tuple[str, ...] = tuple(_BEFORE.format(s) for s in (r"(?:AU|CA|NZ|US)?\$", r"R\$", "€", "£", "(?:CN|JP)?¥")) + (_AFTER.format("AUD|BRL|CAD|CNY|EUR|GBP|INR|JPY|MXN|USD"),)
    images: tuple[str, ...] = _words("gallery image img media photo picture thumb")
    links: tuple[str, ...] = _words("href link permalink slug url")
    ratings: tuple[str, ...] = _words("rating review-score score star")
    endpoints: tuple[str, ...] = _words("ajax api data feed graphql grid item json list page rest result search")
    image_prefix: str | None = None
    core: tuple[str, ...] = ("image", "link", "title")
    least: int = 2
    rate: float = 0.6
    unique: float = 0.65
    schema: dict[str, str] = field(default_factory=dict)


GENERIC = Preset()
_WEST = tuple(_BEFORE.format(s) for s in (r"(?:CA|US)?\$", "€", "£")) + (_AFTER.format("CAD|EUR|GBP|USD"),)
_LOTS = _words("arremat auction bid busca catalog catalogue destaque edital lance leil leilao leiloes lot lote produto")

PRESETS: dict[str, Preset] = {
    "generic": GENERIC,
    "ecommerce": replace(
        GENERIC, prices=tuple(_BEFORE.format(s) for s in (r"(?:AU|CA|US)?\$", "€", "£")) + (_AFTER.format("AUD|CAD|EUR|GBP|USD"),),
        images=_words("cover gallery image img media photo picture product-image thumb thumbnail"), links=_words("handle href link permalink product-url slug url"),
        ratings=_words("average-rating rating review-score score star stars"), schema={"price": "float", "rating": "float"},
    ),
    "auctions": replace(
        GENERIC, prices=_WEST, images=_words("auction-image gallery image img lot-image photo picture thumb"), links=_words("href link lot-url permalink slug url"),
        ratings=_words("rating score star"), endpoints=GENERIC.endpoints + _LOTS, schema={"price": "float"},
    ),
    "properties": replace(
        GENERIC, prices=_WEST, images=_words("gallery image img listing-image media photo picture property-image thumb"), links=_words("href link listing-url permalink slug url"),
        ratings=_words("rating score star"), schema={"area": "float", "bedrooms": "int", "price": "float"},
    ),
    "auctions_pt_BR": replace(
        GENERIC, prices=(_BEFORE.format(r"R\$"),), images=_words("foto fotos galeria image imagem imagens img photo picture thumb tims"), links=_words("href link lote permalink slug url"),
        ratings=_words("avaliacao nota rating star"), image_prefix="/arquivos/", endpoints=GENERIC.endpoints + _LOTS, schema={"price": "float"},
    ),
}


def preset(name: str | None) -> Preset:
    """A preset by name; an unknown one is the generic one."""
    return PRESETS.get(name or "generic", GENERIC)
