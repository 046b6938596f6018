"""The help-desk data model as a bundle of DataFrames.

Tables (one DataFrame each, columns as in the reference's relational model):

* ``customers``   customer_id, external_requester_id, requester_name, requester_email
* ``tickets``     ticket_id, customer_id, status, priority, assignee_external_id,
                  assignee_name, source_created_at, source_updated_at, first_response_at
* ``ticket_text`` ticket_id, subject, description
* ``ratings``     ticket_id, score, offered_at, rated_at, comment
* ``tags``        tag_id, name
* ``ticket_tags`` ticket_id, tag_id

``ticket_id`` doubles as the external ticket id and ``customer_id`` as the
external requester id (natural BIGINT keys; the reference's random UUIDs only
add a lookup). Subject and description live in their own frame so analytics
never read text columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TICKET_CORE_COLUMNS = (
    "ticket_id",
    "customer_id",
    "status",
    "priority",
    "assignee_external_id",
    "assignee_name",
    "source_created_at",
    "source_updated_at",
    "first_response_at",
)
RATING_COLUMNS = ("score", "offered_at", "rated_at", "comment")


@dataclass
class TicketModel:
    """A set of model tables.

    Frames may be given directly or as zero-argument factories; factories are
    evaluated once, on first use, so a query only plans the tables it reads.
    """

    sources: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    # True when tag_id *is* the tag name and every link's tag exists (both
    # the fixture model and the ingested store): the bridge then carries the
    # name itself and no join to ``tags`` is needed — which also removes the
    # one join where a very popular tag would be a hot key.
    tag_ids_are_names: bool = False

    def _get(self, name: str) -> DataFrame:
        value = self.sources[name]
        if callable(value) and not isinstance(value, DataFrame):
            value = value()
            self.sources[name] = value
        return value

    @property
    def customers(self) -> DataFrame:
        return self._get("customers")

    @property
    def tickets(self) -> DataFrame:
        return self._get("tickets")

    @property
    def ticket_text(self) -> DataFrame:
        return self._get("ticket_text")

    @property
    def ratings(self) -> DataFrame:
        return self._get("ratings")

    @property
    def rating_scores(self) -> DataFrame:
        """(ticket_id, score) of rated tickets; cheaper than ``ratings`` when
        the model can derive scores without the rating timestamps."""
        if "rating_scores" in self.sources:
            return self._get("rating_scores")
        return self.ratings.select("ticket_id", "score")

    @property
    def tags(self) -> DataFrame:
        return self._get("tags")

    @property
    def ticket_tags(self) -> DataFrame:
        return self._get("ticket_tags")

    # -- derived frames -----------------------------------------------------
    def rated_tickets(self, rating_columns: tuple[str, ...] = ("score",)) -> DataFrame:
        """Tickets left-joined to their (0..1) rating."""
        if "rated_tickets" in self.sources:
            base = self._get("rated_tickets")
            keep = list(TICKET_CORE_COLUMNS) + list(rating_columns)
            return base.select(*keep)
        ratings = self.ratings.select("ticket_id", *rating_columns)
        return self.tickets.join(ratings, "ticket_id", "left")

    def full_tickets(self) -> DataFrame:
        """Tickets with text and every rating column (exports, listings)."""
        if "full_tickets" in self.sources:
            return self._get("full_tickets")
        return self.rated_tickets(RATING_COLUMNS).join(self.ticket_text, "ticket_id", "left")

    def attach_text(self, frame: DataFrame, columns: tuple[str, ...] = ("subject", "description"),
                    ranges: str | None = None) -> DataFrame:
        """Add text columns (subject, description) to the rows of ``frame``
        (by ticket_id). Models that derive text may override it to work on
        those rows only (``sources['attach_text']``). ``ranges`` is the column
        by which the rows will be sorted: a model may deal them out by it
        before it adds the texts, so that the sort moves no text."""
        if "attach_text" in self.sources:
            return self.sources["attach_text"](frame, columns, ranges)
        return frame.join(self.ticket_text.select("ticket_id", *columns), "ticket_id", "left")

    def topic_links(self) -> DataFrame:
        """J3 bridge: (ticket_id, tag_id, tag) over ticket_tags ⋈ tags."""
        if self.tag_ids_are_names:
            return self.ticket_tags.select("ticket_id", "tag_id", F.col("tag_id").alias("tag"))
        tags = self.tags.select("tag_id", F.col("name").alias("tag"))
        return self.ticket_tags.join(tags, "tag_id", "inner")

    def links_for(self, tickets: DataFrame) -> DataFrame:
        """The bridge rows of the given tickets only (J11: page first, enrich
        after). A model that derives the bridge may override it to restrict
        its sources *before* building it (``sources['links_for']``)."""
        if "links_for" in self.sources:
            return self.sources["links_for"](tickets)
        return self.topic_links().join(tickets.select("ticket_id").distinct(), "ticket_id", "left_semi")

    @cached_property
    def table_names(self) -> tuple[str, ...]:
        return ("customers", "tickets", "ticket_text", "ratings", "tags", "ticket_tags")

    def table(self, name: str) -> DataFrame:
        return self._get(name)
