"""Fixed schemas of every source and result. Nothing is inferred from data."""

from pyspark.sql import types as T

_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_strings = T.ArrayType(_s)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEMPLATES_CSV = _struct(EventId=_s, EventTemplate=_s)
LABELS_CSV = _struct(BlockId=_s, Label=_s)
TRACES_CSV = _struct(BlockId=_s, Label=_s, Type=_s, Features=_s, TimeInterval=_s, Latency=_s)

MESSAGE = _struct(role=_s, content=_s)
CHAT = _struct(messages=T.ArrayType(MESSAGE))
REJECTS = _struct(
    block_id=_s,
    sequence=_strings,
    reason=_s,
    messages=T.ArrayType(MESSAGE),
    _reject_reason=_s,
)
EXPLANATIONS = _struct(block_id=_s, anomaly_type=_i, sequence=_strings, explanation=_s)
REQUESTS = _struct(
    block_id=_s,
    semantic_text_sequence=_strings,
    event_id_sequence=_strings,
    latency=_d,
)
REPLY = _struct(status=_s, explanation=_s)
LIVE = _struct(lvl=_s, ts=T.TimestampType(), text=_s)
SESSIONS = _struct(
    block_id=_s,
    part=_l,
    parts=_l,
    first_pos=_l,
    n_events=_l,
    sequence=_strings,
    latency=_d,
)
