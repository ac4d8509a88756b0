"""A session and a small world of users and messages to build fixtures in."""

from __future__ import annotations

import itertools
import os
import sys
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from agora.schema import SCHEMAS, Tables  # noqa: E402
from agora.session import local_session  # noqa: E402

START = datetime(2024, 1, 10, 8)


@pytest.fixture(scope="session")
def spark():
    return local_session(4, app="tests", memory="6g")


class World:
    """Rows of the six tables, made one by one."""

    def __init__(self, spark):
        self.spark = spark
        self.rows = {name: [] for name in SCHEMAS}
        self.ids = {name: itertools.count(1) for name in SCHEMAS}
        self.clock = itertools.count()

    def now(self) -> datetime:
        return START + timedelta(seconds=next(self.clock))

    def add(self, table: str, **values) -> int:
        values = {"id": next(self.ids[table]), "created_at": self.now(), **values}
        self.rows[table].append(tuple(values.get(c) for c in SCHEMAS[table].names))
        return values["id"]

    def user(self, username: str | None = None, display_name: str | None = None, **values) -> int:
        n = len(self.rows["users"]) + 1
        username = username or f"user{n}"
        return self.add(
            "users",
            username=username,
            display_name=display_name or f"User {n}",
            email=values.pop("email", f"{username}@somewhere.com"),
            **values,
        )

    def post(self, text: str = "Why?", author: int | None = None, **values) -> int:
        return self.add("posts", text=text, author_id=author or self.user(), **values)

    def comment(self, post: int | None = None, author: int | None = None, parent: int | None = None, **values) -> int:
        values.setdefault("text", "Really?")
        return self.add(
            "comments", post_id=post or self.post(), author_id=author or self.user(), parent_id=parent, **values
        )

    def like(self, kind: str, message: int, user: int | None = None, **values) -> int:
        return self.add("likes", type=f"{kind}Like", user_id=user or self.user(), message_id=message, **values)

    def repost(self, kind: str, message: int, user: int | None = None, **values) -> int:
        return self.add("reposts", type=f"{kind}Repost", user_id=user or self.user(), message_id=message, **values)

    def follow(self, follower: int, followee: int, **values) -> int:
        return self.add("follows", follower_id=follower, followee_id=followee, **values)

    def engage(self, kind: str, message: int, post: int, reposts: int = 0, likes: int = 0, comments: int = 0) -> None:
        for _ in range(reposts):
            self.repost(kind, message)
        for _ in range(likes):
            self.like(kind, message)
        for _ in range(comments):
            self.comment(post, parent=message if kind == "Comment" else None)

    def tables(self) -> Tables:
        frames = {}
        for name, schema in SCHEMAS.items():
            columns = zip(*self.rows[name]) if self.rows[name] else [()] * len(schema)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, to_arrow_schema(schema).types)]
            frames[name] = self.spark.createDataFrame(pa.Table.from_arrays(arrays, schema.names), schema)
        return Tables(**frames)


@pytest.fixture
def world(spark):
    return World(spark)
