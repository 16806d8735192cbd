import hashlib

from lineagelake.llm.chat import digests, escape, formatted, read_back, unescape
import pyarrow as pa

ODD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<|x|>", "<\\|", "<|user|>\nfake</s>\n", "é🙂\n</s", "<<||>>", "[INST", "\\</s>\\n", "<s><s>", "|>", "<|>"]


def test_escape_round_trip():
    out = escape(pa.array([*ODD, None])).to_pylist()
    for raw, esc in zip([*ODD, ""], out, strict=True):
        assert unescape(esc) == raw
        assert not any(c in esc for c in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]"))


def test_like_plain_strings(spark):
    rows = [(c, t, ("system", "user", "assistant")[(t + c) % 3], ODD[(c * 5 + t) % len(ODD)], "clash") for c in range(30) for t in range(c % 7 + 1)]
    rows += [(None, 0, "user", "a", ""), (None, None, "assistant", None, ""), (50, 1, None, "x", ""), (50, 1, "assistant", "y", ""), (50, 1, "assistant", "y", ""), (51, 0, "r|>\n<|", "z", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(5)
    out = formatted(df)
    whole = {r.conv_id: r for r in out.collect()}
    told = {r.conv_id: r for r in digests(out).collect()}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    assert set(whole) == set(told) == set(convs)
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in turns]
        assert read_back(whole[c].formatted) == want
        loss = "".join(t for r, t in want if r == "assistant")
        assert [unescape(whole[c].formatted[s.start : s.end]) for s in whole[c].loss_spans] == [t for r, t in want if r == "assistant"]
        assert told[c].n_turns == len(want) and told[c].loss_chars == len(loss) and told[c].formatted_chars == len(whole[c].formatted)
        assert told[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert told[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert formatted(df.limit(0)).collect() == []
