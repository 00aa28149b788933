"""Journeys by joins, on small networks made here."""

from itertools import product

from wayfold.operators import routing

PAIRS = "from_stop bigint, to_stop bigint, route_id bigint, direction int, ride_s bigint"


def test_a_loop_line_leaves_other_rides_in_the_choice(spark):
    """Ten quick rides of one loop line between two stops: the only valid journey takes another line there."""
    rides = [(1, 2, 2, 0, 900), (2, 3, 1, 0, 300), (3, 4, 3, 0, 300), *[(1, 2, 1, 0, 100 + k) for k in range(10)]]
    pairs, asked = spark.createDataFrame(rides, PAIRS), spark.createDataFrame([(7, 1, 4)], "request bigint, from_stop bigint, to_stop bigint")
    got = [tuple(r) for r in routing.two_transfer_journeys(asked, pairs).collect()]
    assert got == [(7, 2, 3, 2, 1, 3, 900 + 300 + 300 + 600)]


def test_two_transfers_equal_all_triples(spark):
    rides = [(a, b, (a * 3 + b * k) % 4, k % 2, 60 + (a * 37 + b * 61 + k * 97) % 400) for a, b, k in product(range(5), range(5), range(6)) if a != b]
    pairs, asked = spark.createDataFrame(rides, PAIRS), spark.createDataFrame([(1, 0, 4), (2, 3, 1)], "request bigint, from_stop bigint, to_stop bigint")
    want = {}
    for request, a, d in ((1, 0, 4), (2, 3, 1)):
        found = []
        for x, y, z in product(rides, rides, rides):
            if x[0] == a and z[1] == d and x[1] == y[0] and y[1] == z[0] and len({x[2], y[2], z[2]}) == 3:
                found.append((x[4] + y[4] + z[4] + 600, x[2], y[2], z[2], x[1], y[1], x[3], y[3], z[3]))
        want[request] = sorted(found)[:5]
    for request in want:
        got = sorted((r["total_s"], r["route_1"], r["route_2"], r["route_3"], r["change_1"], r["change_2"]) for r in routing.two_transfer_journeys(asked, pairs).where(f"request = {request}").collect())
        assert got == [w[:6] for w in want[request]]
