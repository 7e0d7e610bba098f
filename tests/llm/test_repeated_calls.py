"""Repeated identifiers of calls and results: none is lost, none multiplies."""

from tagwise.llm import chat_format


def test_the_kth_call_meets_the_kth_result(spark):
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    query = lambda n: f'{{"limit": {n}, "query": "q"}}'
    calls = spark.createDataFrame(
        [
            (1, 1, "call_1", "lookup", query(1), []), (1, 1, "call_2", "lookup", query(2), ["call_1"]),
            (1, 3000, "call_1", "lookup", query(3), ["call_1"]), (1, 3000, "call_2", "lookup", query(4), ["call_1"]),
            (1, 3000, "call_1", "lookup", query(5), []), (2, 1, "call_1", "lookup", query(6), ["call_1"]),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame(
        [(1, 2, "call_1", "a"), (1, 3001, "call_1", "b"), (1, 2, "call_2", "c"), (2, 2, "call_1", "d"), (2, 3, "call_1", "e")],
        "conv_id long, turn long, call_id string, content string",
    )
    found = chat_format.formatted(messages, calls, results, chat_format.SCHEMAS).collect()
    limit = lambda r: r.json.partition('"limit":')[2][:1]
    result = lambda r: r.json.partition('"result":"')[2][:1]
    assert sorted((r.conv_id, r.call_id, r.occurrence, limit(r), result(r), r.status, r.depth) for r in found) == [
        (1, "call_1", 1, "1", "a", "linked", 0), (1, "call_1", 2, "3", "b", "linked", 1),
        (1, "call_1", 3, "5", "", "no result", 0), (1, "call_2", 1, "2", "c", "linked", 1),
        (1, "call_2", 2, "4", "", "no result", 2), (2, "call_1", 1, "6", "d", "linked", None),
        (2, "call_1", 2, "", "e", "no call", None),
    ]
