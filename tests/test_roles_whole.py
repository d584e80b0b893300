import json

from turnloom.plans.conversations import roles_with_tools


def test_all_turns_in_qwen(spark, sf, tmp_path):
    """Against brute force, calls included."""
    rows = spark.read.parquet(f"{sf}/toolcall_dpo_zh_demo.parquet").collect()
    made = [(-1, [("human", "a"), ("function_call", '{"name": "f", "arguments": {"x": 1}}'), ("observation", "b"), ("function_call", "no JSON"), ("gpt", None)])]
    df = spark.createDataFrame([(r.pref_id, r.conversations) for r in rows] + made, "pref_id bigint, conversations array<struct<`from`:string,value:string>>")
    df.write.parquet(f"{tmp_path}/toolcall_dpo_zh_demo.parquet")
    want = {}
    for key, conversation in {r[0]: r[1] for r in [(r.pref_id, r.conversations) for r in rows] + made}.items():
        for k, (role, text) in enumerate(conversation or []):
            text = text or ""
            if role == "function_call":
                try:
                    v = json.loads(text)
                    text = '<tool_call>\n{"name": "' + v["name"] + '", "arguments": ' + json.dumps(v["arguments"], ensure_ascii=False) + "}\n</tool_call>"
                except ValueError:
                    text = None
            elif role == "observation":
                text = f"<tool_response>\n{text}\n</tool_response>"
            if role in ("human", "observation", "gpt", "function_call"):
                want[key, k] = ("user" if role in ("human", "observation") else "assistant", text)
    got = roles_with_tools(spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in got} == want and len(got) == len(want)
    assert sum(t is not None and t.startswith("<tool_call>") for _, t in want.values()) > 1
