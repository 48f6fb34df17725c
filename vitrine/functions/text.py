"""Text clean-up and the templates that feed the embedder."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a word (Unicode white space and separators).
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

SPACES = "".join(chr(code) for code in range(0x3001) if re.fullmatch(SPACE_CLASS, chr(code)))

# Words added to a text for its price band.
BUDGET_WORDS = "affordable budget-friendly económico barato"
MIDDLE_WORDS = "mid-range precio medio"
PREMIUM_WORDS = "premium high-end caro premium"


def words(text: Column) -> Column:
    """Words of a text, without empty ones."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def trim_space(text: Column) -> Column:
    """White space cut off both ends, looking at the ends only."""
    return F.btrim(text, F.lit(SPACES))


def slug(title: Column) -> Column:
    """URL handle. Runs of dashes collapse before other characters are dropped,
    so ``A & B`` becomes ``a--b``."""
    dashed = F.replace(F.lower(title), F.lit(" "), F.lit("-"))
    bare = F.translate(dashed, ":|", "")
    single = F.regexp_replace(trim_space(bare), "-+", "-")
    return F.regexp_replace(single, "[^a-z0-9-]", "")


def strip_html(html: Column) -> Column:
    return trim_space(F.regexp_replace(html, "<[^>]*>", " "))


def parse_tags(tags: Column) -> Column:
    """Comma list to array, each tag trimmed; empty or NULL text gives ``[]``."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(tags, F.lit("")) == "", empty).otherwise(
        F.transform(F.split(tags, ","), trim_space)
    )


def tenant_host(url: Column) -> Column:
    """Host of a tenant URL: no scheme, nothing from the first slash on."""
    return F.split(F.regexp_replace(url, "https?://", ""), "/")[0]


def cache_key(model: str, text: Column) -> Column:
    """Fixed-size key of a cached embedding; the text itself may be long."""
    return F.sha2(F.concat(F.lit(f"embedding:{model}:"), text), 256)


def settings_key(shop: Column, name: str) -> Column:
    return F.concat(shop, F.lit(f":{name}"))


def labelled(label: str, value: Column) -> Column:
    """``"Label: value"``, or NULL where the value is NULL or empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def labelled_list(label: str, values: Column) -> Column:
    return F.when(
        F.coalesce(F.size(values), F.lit(0)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", "))
    )


def filled(value: Column) -> Column:
    return F.when(value != "", value)


def _join(separator: str, parts: list[Column]) -> Column:
    return F.concat_ws(separator, *parts)


def price_band(price: Column) -> Column:
    """``budget`` below 50, ``mid`` below 150, else ``premium``; NULL when not positive."""
    return F.when(price > 0, F.when(price < 50, "budget").when(price < 150, "mid").otherwise("premium"))


def price_words(price: Column) -> Column:
    band = price_band(price)
    return (
        F.when(band == "budget", BUDGET_WORDS).when(band == "mid", MIDDLE_WORDS).when(band == "premium", PREMIUM_WORDS)
    )


def multilingual_text(
    title: Column, description: Column, translations: Column, vendor: Column, category: Column, tags: Column
) -> Column:
    """Title, description and translations, then brand, category and tags.

    ``translations`` is an array of ``struct<title, description>`` in payload order.
    """
    translated = F.flatten(
        F.transform(
            translations,
            lambda t: F.array(
                F.when(t["title"] != "", F.concat(F.lit("| "), t["title"])), filled(t["description"])
            ),
        )
    )
    return _join(
        " ",
        [
            F.coalesce(title, F.lit("")),
            filled(description),
            filled(F.array_join(translated, " ")),
            labelled("Brand", vendor),
            labelled("Category", category),
            labelled_list("Tags", tags),
        ],
    )


def storefront_text(title: Column, product_type: Column, vendor: Column, html: Column, tags: Column) -> Column:
    """Parts joined by ``" | "`` with the markup taken out of the description."""
    description = F.when(F.coalesce(html, F.lit("")) != "", strip_html(html))
    return _join(
        " | ",
        [
            filled(title),
            labelled("Category", product_type),
            labelled("Brand", vendor),
            description,
            labelled_list("Tags", tags),
        ],
    )


def bilingual_text(
    title: Column,
    description: Column,
    vendor: Column,
    category: Column,
    product_type: Column,
    tags: Column,
    price: Column,
    colors: Column | None = None,
    sizes: Column | None = None,
    material: Column | None = None,
) -> Column:
    """Doubled title and English plus Spanish labels, price words, metadata."""
    pairs = [(vendor, "Brand", "Marca"), (category, "Category", "Categoría"), (product_type, "Type", "Tipo")]
    parts = [filled(title), filled(title), filled(description)]
    for value, english, spanish in pairs:
        parts += [labelled(english, value), labelled(spanish, value)]
    parts += [labelled_list("Tags", tags), labelled_list("Etiquetas", tags), price_words(price)]
    extras = {"Colors": colors, "Sizes": sizes, "Material": material}
    parts += [labelled(name, value) for name, value in extras.items() if value is not None]
    return _join(" ", parts)


def weighted_text(title: Column, description: Column, vendor: Column) -> Column:
    """Doubled title, description, brand."""
    doubled = F.array_join(F.array_repeat(filled(title), 2), " ")
    return _join(" ", [filled(doubled), filled(description), labelled("Brand", vendor)])


def category_text(
    title: Column,
    description: Column,
    category: Column,
    tags: Column,
    category_label: str = "Category",
    tags_label: str = "Tags",
) -> Column:
    return _join(
        " ",
        [title, filled(description), labelled(category_label, category), labelled_list(tags_label, tags)],
    )


def flat_text(title: Column, description: Column, vendor: Column, category: Column, tags: Column) -> Column:
    """Every field in one line; NULL fields are left out."""
    return _join(" ", [title, description, vendor, category, filled(F.array_join(tags, " "))])


def title_text(title: Column, description: Column, separator: str = " ") -> Column:
    return F.concat(title, F.lit(separator), F.coalesce(description, F.lit("")))
