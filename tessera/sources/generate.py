"""Random documents for load tests, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the interface: collections, fields with their kinds, and the words of a kind.
COLLECTIONS = ["orders", "users", "products", "inventory", "logs", "reviews", "sessions", "carts"]
FIELDS = {
    "name": "name", "title": "string", "description": "words", "email": "email", "phone": "phone", "city": "city", "address": "address", "country": "string",
    "zip_code": (10000, 99999), "price": (10, 5000), "quantity": (1, 100), "age": (18, 99), "rating": (1, 5), "discount": (0, 50),
    "is_active": "boolean", "is_verified": "boolean", "on_sale": "boolean", "created_at": "date", "updated_at": "date", "last_login": "date", "order_date": "date",
    "status": "status", "category": "category", "tags": "tags", "notes": "words",
}
STATUS = ["pending", "processing", "shipped", "delivered", "cancelled", "returned"]
CATEGORY = ["electronics", "apparel", "books", "home", "grocery", "toys", "sports", "tools"]
TAGS = ["new", "sale", "featured", "popular", "limited", "eco-friendly"]
# Words of our own.
FIRST, LAST = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gita", "Hugo"], ["Abel", "Brand", "Costa", "Dahl", "Engel", "Falk", "Gruber", "Haas"]
CITY, STREET = ["Aarhus", "Bergen", "Cork", "Dijon", "Essen", "Faro"], ["Mill Lane", "Station Road", "Hill Street", "River Walk", "Market Square"]
DOMAIN, WORD = ["example.com", "example.org", "example.net"], "amber brook cedar delta ember fjord grove harbor island juniper kettle lantern meadow north orchard pebble".split()


class Dice:
    """Random columns, each from a seed of its own."""

    def __init__(self, seed: int):
        self._seeds: Iterator[int] = iter(range(seed * 100_000, (seed + 1) * 100_000))

    def roll(self, lo: int, hi: int) -> Column:
        return (F.floor(F.rand(next(self._seeds)) * (hi - lo + 1)) + lo).cast("long")

    def one(self, of: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, of)), self.roll(1, len(of)).cast("int"))

    def some(self, of: list[str], least: int, most: int) -> Column:
        """Different ones, in random order."""
        order = F.array_sort(F.array(*(F.struct(F.rand(next(self._seeds)).alias("r"), F.lit(x).alias("x")) for x in of)))
        return F.slice(F.transform(order, lambda s: s["x"]), F.lit(1), self.roll(least, most).cast("int"))


def _kinds(d: Dice) -> dict[str, Callable[[], Column]]:
    text = lambda c: c.cast("string")
    return {
        "name": lambda: F.concat_ws(" ", d.one(FIRST), d.one(LAST)),
        "string": lambda: d.one(WORD),
        "words": lambda: F.concat_ws(" ", F.slice(F.array(*(d.one(WORD) for _ in range(10))), F.lit(1), d.roll(3, 10).cast("int"))),
        "email": lambda: F.concat(F.lower(d.one(FIRST)), F.lit("."), F.lower(d.one(LAST)), text(d.roll(0, 999)), F.lit("@"), d.one(DOMAIN)),
        "phone": lambda: F.concat(F.lit("09"), text(d.roll(10, 99)), F.lit("-"), text(d.roll(100, 999)), F.lit("-"), text(d.roll(1000, 9999))),
        "city": lambda: d.one(CITY),
        "address": lambda: F.concat_ws(" ", text(d.roll(1, 1000)), d.one(STREET)),
        "boolean": lambda: d.roll(0, 1) == 1,
        "date": lambda: F.date_format(F.timestamp_seconds(1_700_000_000 - d.roll(0, 729) * 86400), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "status": lambda: d.one(STATUS),
        "category": lambda: d.one(CATEGORY),
        "tags": lambda: d.some(TAGS, 1, 3),
    }


def random_documents(spark: SparkSession, n: int, seed: int = 0, least: int = 8, most: int = 16) -> DataFrame:
    """``collection``, ``_id`` and all fields, of which each document has ``least`` to ``most`` (the others are null); the same for the same seed."""
    d = Dice(seed)
    kinds = _kinds(d)
    values = {f: d.roll(*kind).cast("double") if isinstance(kind, tuple) else kinds[kind]() for f, kind in FIELDS.items()}
    rows = spark.range(n).select(
        d.one(COLLECTIONS).alias("collection"), F.sha2(F.concat_ws("-", F.lit(seed), "id"), 256).substr(1, 24).alias("_id"), d.some(list(FIELDS), least, most).alias("has"),
        *(v.alias(f) for f, v in values.items()),
    )
    return rows.select("collection", "_id", *(F.when(F.array_contains("has", f), F.col(f)).alias(f) for f in FIELDS))


def load_random(store, n: int, seed: int = 0) -> int:
    """Random documents into their collections, in one commit; null fields are left out."""
    rows = random_documents(store.spark, n, seed)
    doc = F.to_json(F.struct("_id", *FIELDS))
    return store.commit(rows.select("collection", "_id", doc.alias("doc"), F.lit(False).alias("tombstone"), F.lit(0).cast("long").alias("ord")))
