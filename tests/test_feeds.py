from datetime import timedelta

import pytest

from agora.plans import feeds
from tests.conftest import START


def test_popular_feed(world):
    today, earlier = START, START - timedelta(days=2)

    def post(at, reposts, likes, comments):
        made = world.post(created_at=at)
        world.engage("Post", made, made, reposts, likes, comments)
        return made

    now_counts = [(4, 3, 2), (2, 5, 1), (9, 1, 3), (1, 8, 4), (0, 2, 6)]
    then_counts = [(3, 3, 3), (5, 0, 2), (0, 6, 1), (1, 1, 0), (6, 2, 5)]
    now = [post(today, *c) for c in now_counts]
    then = [post(earlier, *c) for c in then_counts]
    base = world.post(created_at=earlier)

    def comment(at, reposts, likes=0):
        made = world.comment(base, created_at=at)
        world.engage("Comment", made, base, reposts, likes)
        return made

    popular = [comment(today, 6), comment(today, 5), comment(earlier, 5)]
    comment(today, 4), comment(today, 0, 7)
    viewer = world.user()
    tables = world.tables()
    rows = feeds.popular_feed(tables, viewer).collect()
    def rating(reposts, likes, comments):
        return 3 * reposts + 2 * likes + comments

    day = [("Post", p, rating(*c)) for p, c in zip(now, now_counts)]
    day += [("CommentRepost", popular[0], rating(6, 0, 0)), ("CommentRepost", popular[1], rating(5, 0, 0))]
    before = [("Post", p, rating(*c)) for p, c in zip(then, then_counts)]
    before += [("CommentRepost", popular[2], rating(5, 0, 0)), ("Post", base, 5)]

    def best(entries):
        return sorted(entries, key=lambda e: (-e[2], -e[1]))

    assert [(r.post_type, r.id, r.rating) for r in rows] == best(day) + best(before)
    for limit in (1, 6, 9, 50):
        assert feeds.popular_feed(tables, viewer, limit).collect() == rows[:limit]


@pytest.fixture
def home(world):
    viewer = world.user("me", "Me")
    friends = [world.user(f"friend{i}", f"Friend {i}") for i in range(2)]
    stranger = world.user("stranger", "Stranger")
    for friend in friends:
        world.follow(viewer, friend)
    made = {
        "own": world.post(author=viewer),
        "friend": world.post(author=friends[0]),
        "shared": world.post(author=stranger),
        "unseen": world.post(author=stranger),
    }
    made["comment"] = world.comment(made["shared"], stranger)
    world.comment(made["own"], friends[0])
    world.repost("Post", made["shared"], friends[0])
    world.repost("Post", made["shared"], friends[1])
    world.repost("Post", made["friend"], viewer)
    world.repost("Comment", made["comment"], friends[1])
    world.repost("Comment", made["comment"], viewer)
    world.repost("Post", made["own"], friends[0])
    return viewer, friends, made


def test_home_feed(world, home):
    viewer, _, made = home
    rows = feeds.home_feed(world.tables(), viewer).collect()
    seen = {(r.post_type, r.id): r for r in rows}
    assert set(seen) == {
        ("Post", made["own"]), ("PostRepost", made["own"]), ("Post", made["friend"]), ("PostRepost", made["friend"]),
        ("PostRepost", made["shared"]), ("CommentRepost", made["comment"]),
    }
    assert seen["PostRepost", made["shared"]].reposted_by == "Friend 1"
    assert seen["PostRepost", made["friend"]].reposted_by == "You"
    assert seen["PostRepost", made["friend"]].reposted_by_username == "me"
    assert seen["CommentRepost", made["comment"]].reposted_by == "You"
    assert seen["CommentRepost", made["comment"]].replying_to == ["stranger"]
    assert seen["CommentRepost", made["comment"]].user_reposted
    assert seen["Post", made["friend"]].user_followed and seen["Post", made["friend"]].reposted_by is None
    assert not seen["Post", made["own"]].user_followed and not seen["Post", made["own"]].user_reposted
    keys = [(r.post_date.date(), r.rating, r.id, r.post_date) for r in rows]
    assert keys == sorted(keys, reverse=True)


def test_home_feed_needs_a_viewer(world):
    with pytest.raises(ValueError):
        feeds.home_feed(world.tables(), None)


@pytest.mark.parametrize("top", [1, 2, 20])
def test_everybodys_home_feed_is_each_home_feed(world, home, top):
    viewer, friends, _ = home
    world.follow(friends[0], friends[1])
    tables = world.tables()
    rows = feeds.home_feed_all(tables, top).drop("viewer_id", "position").columns
    every = feeds.home_feed_all(tables, top).orderBy("viewer_id", "position").collect()
    for reader in (viewer, friends[0]):
        mine = [tuple(r[c] for c in rows) for r in every if r.viewer_id == reader]
        assert mine == [tuple(r) for r in feeds.home_feed(tables, reader).select(*rows).limit(top).collect()]
