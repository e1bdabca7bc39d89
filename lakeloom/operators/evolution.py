"""Schemas with field flags, per-field consistency, evolution on write, defaults on read, and explicit updates."""

from __future__ import annotations

import copy
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the greatest field id.
MAX_FIELD_ID = 2147483447
#: Columns of the engine itself begin so; fields may not.
RESERVED = "__"
NONE, COERCE, VALIDATE = "NONE", "COERCE", "VALIDATE"
AUTO, MANUAL, DISABLED = "AUTO", "MANUAL", "DISABLED"


class SchemaError(ValueError):
    """Data or an update that the schema does not allow."""


@dataclass(frozen=True)
class Field:
    """A column with its flags. Key and order columns are validated; ``future_default`` falls back to ``past_default``."""

    name: str
    type: str
    id: int | None = None
    nullable: bool = True
    merge_key: bool = False
    merge_order: str | None = None  # asc or desc
    event_time: bool = False
    doc: str | None = None
    past_default: object = None
    future_default: object = None
    consistency: str | None = None

    @property
    def spark(self) -> T.DataType:
        return T._parse_datatype_string(self.type) if "<" in self.type else _simple(self.type)

    def checked(self, default_consistency: str = NONE) -> Field:
        """The field with its defaults filled in; raises SchemaError for flags that its type forbids."""
        kind = self.spark
        special = self.merge_key or self.merge_order or self.event_time
        if self.merge_key and (isinstance(kind, T.FloatType | T.DoubleType) or _nested(kind)):
            raise SchemaError(f"{self.name}: a merge key is a whole, text, time or boolean type, not {self.type}")
        if self.merge_order and _nested(kind):
            raise SchemaError(f"{self.name}: a merge order needs a primitive type")
        if self.event_time and not isinstance(kind, T.IntegralType | T.FloatType | T.DoubleType | T.DateType | T.TimestampType | T.TimestampNTZType):
            raise SchemaError(f"{self.name}: an event time is a number or a time, not {self.type}")
        consistency = self.consistency or (VALIDATE if special else default_consistency)
        if special and consistency != VALIDATE:
            raise SchemaError(f"{self.name}: keys, orders and event times are validated")
        future = self.past_default if self.future_default is None else self.future_default
        return replace(self, consistency=consistency, future_default=future)

    def struct_field(self) -> T.StructField:
        """The Spark field; flags are kept as metadata under the same names."""
        meta = {k: v for k, v in asdict(self).items() if k not in ("name", "type", "nullable") and v not in (None, False)}
        return T.StructField(self.name, self.spark, self.nullable, json.loads(json.dumps(meta, default=str)))


def _simple(name: str) -> T.DataType:
    return T._parse_datatype_string(name)


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.MapType | T.StructType)


_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
#: Whole digits that a decimal takes over from a whole type.
_DIGITS = {T.ByteType(): 2, T.ShortType(): 4, T.IntegerType(): 9, T.LongType(): 18}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds both, by the permissive rules of the columnar library; never text as a way out.

    Raises SchemaError for pairs without one (date and timestamp, boolean and number, number and text).
    """
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if a in _WHOLE and b in _WHOLE:
        return _WHOLE[max(_WHOLE.index(a), _WHOLE.index(b))]
    for x, y in ((a, b), (b, a)):
        if isinstance(x, T.DoubleType) and (y in _WHOLE or isinstance(y, T.FloatType | T.DecimalType)):
            return x
        if isinstance(x, T.FloatType) and isinstance(y, T.DecimalType):
            return x
        if isinstance(x, T.FloatType) and y in _WHOLE:
            return T.DoubleType() if y in _WHOLE[2:] else x
        if isinstance(x, T.DecimalType) and y in _WHOLE:
            whole = max(x.precision - x.scale, _DIGITS[y])
            if whole + x.scale > 38:
                raise SchemaError(f"{x.simpleString()} and {y.simpleString()} need more than 38 digits")
            return T.DecimalType(whole + x.scale, x.scale)
        if isinstance(x, T.BinaryType) and isinstance(y, T.StringType):
            return x
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType), a.valueContainsNull or b.valueContainsNull)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = [T.StructField(f.name, common_type(f.dataType, b[f.name].dataType) if f.name in b.names else f.dataType, True) for f in a.fields]
        return T.StructType([*fields, *[f for f in b.fields if f.name not in a.names]])
    raise SchemaError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def compatible(old: T.DataType, new: T.DataType) -> bool:
    """Whether values of ``old`` stay readable as ``new``: wider numbers, whole to floating, supersets of structs."""
    if old == new or isinstance(old, T.NullType):
        return True
    if old in _WHOLE and new in _WHOLE:
        return _WHOLE.index(old) <= _WHOLE.index(new)
    if isinstance(new, T.DoubleType):
        return old in _WHOLE or isinstance(old, T.FloatType)
    if isinstance(new, T.FloatType):
        return old in _WHOLE
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return compatible(old.elementType, new.elementType)
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return compatible(old.keyType, new.keyType) and compatible(old.valueType, new.valueType)
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return all(f.name in new.names and compatible(f.dataType, new[f.name].dataType) for f in old.fields) and all(f.nullable for f in new.fields if f.name not in old.names)
    return False


def safe_cast(c: Column, old: T.DataType, new: T.DataType) -> Column:
    """A cast that fails instead of losing anything: ANSI rules, and no fraction may be cut off."""
    if isinstance(old, T.FloatType | T.DoubleType | T.DecimalType) and new in _WHOLE:
        lossy = c.isNotNull() & (c != F.floor(c))
        return F.when(lossy, F.raise_error(F.lit("a fraction would be lost"))).otherwise(c).cast(new)
    return c.cast(new)


@dataclass
class Schema:
    """Fields by id. Names are unique without case; ids grow and are never used twice."""

    fields: list[Field]
    id: int = 0
    last_field_id: int = 0
    groups: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, fields: Sequence[Field], default_consistency: str = NONE) -> Schema:
        names = [f.name.lower() for f in fields]
        if len(set(names)) != len(names):
            raise SchemaError("field names must be unique without case")
        if any(n.startswith(RESERVED) for n in names):
            raise SchemaError(f"names that begin with {RESERVED} are the engine's own")
        out, used, at = [], {f.id for f in fields if f.id is not None}, 0
        for f in fields:
            if f.id is None:
                at += 1
                while at in used:
                    at += 1
                f = replace(f, id=at)
            if not 0 <= f.id <= MAX_FIELD_ID:
                raise SchemaError(f"field id {f.id} is out of range")
            out.append(f.checked(default_consistency))
        return cls(out, 0, max([f.id for f in out], default=0))

    @classmethod
    def infer(cls, df: DataFrame, merge_keys: Sequence[str] = (), default_consistency: str = NONE) -> Schema:
        return cls.of([Field(f.name, f.dataType.simpleString(), nullable=f.nullable, merge_key=f.name in merge_keys) for f in df.schema.fields], default_consistency)

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name.lower() == name.lower()), None)

    @property
    def merge_keys(self) -> list[str]:
        return [f.name for f in self.fields if f.merge_key]

    @property
    def merge_orders(self) -> list[tuple[str, bool]]:
        return [(f.name, f.merge_order == "asc") for f in self.fields if f.merge_order]

    @property
    def event_time(self) -> str | None:
        return next((f.name for f in self.fields if f.event_time), None)

    def struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def group(self, name: str) -> list[str]:
        """The columns of a named subschema."""
        return self.groups[name]

    def to_json(self) -> dict:
        return {"id": self.id, "last_field_id": self.last_field_id, "groups": self.groups, "fields": [asdict(f) for f in self.fields]}

    @classmethod
    def from_json(cls, data: dict) -> Schema:
        return cls([Field(**f) for f in data["fields"]], data["id"], data["last_field_id"], data.get("groups", {}))


def coerce_write(df: DataFrame, schema: Schema, mode: str = AUTO, default_consistency: str = NONE, fill_missing: bool = True) -> tuple[DataFrame, Schema]:
    """``df`` as it is to be written, and the schema it leaves behind (evolved in AUTO mode).

    Per field: VALIDATE demands the exact type, COERCE casts or fails, NONE promotes the schema to the common type. New
    columns are added in AUTO mode, else refused. Missing ones take the future default, else null, else raise; with
    ``fill_missing`` false (partial upserts) they stay missing. Fields come in the schema's order, new ones last.
    """
    new = copy.deepcopy(schema)
    given = {c.lower(): c for c in df.columns}
    if len(given) != len(df.columns):
        raise SchemaError("column names clash without case")
    cols, changed = [], False
    for n, f in enumerate(list(new.fields)):
        c = given.get(f.name.lower())
        if c is None:
            if not fill_missing and not f.merge_key:
                continue
            if f.future_default is not None:
                cols.append(F.lit(f.future_default).cast(f.spark).alias(f.name))
            elif f.nullable and not f.merge_key:
                cols.append(F.lit(None).cast(f.spark).alias(f.name))
            else:
                raise SchemaError(f"{f.name} is missing and has no default")
            continue
        have, x = df.schema[c].dataType, F.col(f"`{c}`")
        if have == f.spark or isinstance(have, T.NullType):
            cols.append(x.cast(f.spark).alias(f.name))
        elif f.consistency == VALIDATE:
            raise SchemaError(f"{f.name} is {f.type}, not {have.simpleString()}")
        elif f.consistency == COERCE:
            cols.append(safe_cast(x, have, f.spark).alias(f.name))
        else:
            wide = common_type(f.spark, have)
            if wide != f.spark:
                if mode != AUTO:
                    raise SchemaError(f"{f.name} would become {wide.simpleString()}")
                new.fields[n] = replace(f, type=wide.simpleString())
                changed = True
            cols.append(x.cast(wide).alias(f.name))
    for c in df.columns:
        if new.find(c) is None:
            if mode != AUTO:
                raise SchemaError(f"{c} is not in the schema")
            new.last_field_id += 1
            new.fields.append(Field(c, df.schema[c].dataType.simpleString(), new.last_field_id).checked(default_consistency))
            cols.append(F.col(f"`{c}`"))
            changed = True
    if changed:
        new.id += 1
    return df.select(*cols), new


def coerce_read(df: DataFrame, written: Schema, current: Schema) -> DataFrame:
    """Rows written under an older schema as the current one: matched by field id, cast, past defaults for new fields."""
    by_id = {f.id: f for f in written.fields}
    cols = []
    for f in current.fields:
        old = by_id.get(f.id)
        if old is not None and old.name in df.columns:
            cols.append(F.col(f"`{old.name}`").cast(f.spark).alias(f.name))
        else:
            cols.append(F.lit(f.past_default).cast(f.spark).alias(f.name))
    rest = [c for c in df.columns if c.startswith(RESERVED)]  # system columns stay
    return df.select(*cols, *[f"`{c}`" for c in rest])


@dataclass(frozen=True)
class Update:
    """add, remove, rename, type, doc, nullable, consistency or future_default of one field."""

    kind: str
    name: str
    value: object = None


#: Consistency changes that are allowed.
TRANSITIONS = {(VALIDATE, COERCE), (VALIDATE, NONE), (COERCE, NONE), (COERCE, VALIDATE)}


def apply_updates(schema: Schema, updates: Sequence[Update], allow_incompatible: bool = False, mode: str = MANUAL) -> Schema:
    """The schema after explicit updates, checked as a whole; DISABLED refuses all. Ids of removed fields are not used again."""
    if mode == DISABLED:
        raise SchemaError("schema evolution is disabled")
    kinds: dict[str, set[str]] = {}
    for u in updates:
        kinds.setdefault(u.name.lower(), set()).add(u.kind)
    for name, k in kinds.items():
        if len(k & {"add", "remove"}) == 2 or ("remove" in k and len(k) > 1) or ("add" in k and len(k) > 1):
            raise SchemaError(f"conflicting updates of {name}")
    new = copy.deepcopy(schema)
    for u in updates:
        at = next((n for n, f in enumerate(new.fields) if f.name.lower() == u.name.lower()), None)
        if u.kind == "add":
            if at is not None:
                raise SchemaError(f"{u.name} exists")
            f = u.value if isinstance(u.value, Field) else Field(u.name, str(u.value))
            if not f.nullable and f.past_default is None and not allow_incompatible:
                raise SchemaError(f"{u.name}: a new field is nullable or has a default")
            new.last_field_id += 1
            new.fields.append(replace(f, name=u.name, id=new.last_field_id).checked())
            continue
        if at is None:
            raise SchemaError(f"no field {u.name}")
        f = new.fields[at]
        if u.kind == "remove":
            if f.merge_key or not allow_incompatible:
                raise SchemaError(f"removing {u.name} is incompatible")
            del new.fields[at]
        elif u.kind == "rename":
            if new.find(str(u.value)) not in (None, f):
                raise SchemaError(f"{u.value} exists")
            new.fields[at] = replace(f, name=str(u.value))
        elif u.kind == "type":
            kind = _simple(str(u.value))
            if f.merge_key or f.merge_order or f.event_time:
                raise SchemaError(f"{u.name}: keys and orders keep their type")
            if not compatible(f.spark, kind) and not allow_incompatible:
                raise SchemaError(f"{u.name}: {f.type} is not readable as {u.value}")
            new.fields[at] = replace(f, type=kind.simpleString())
        elif u.kind == "nullable":
            if f.nullable and not u.value and (f.past_default is None or f.future_default is None) and not allow_incompatible:
                raise SchemaError(f"{u.name}: a required field needs both defaults")
            new.fields[at] = replace(f, nullable=bool(u.value))
        elif u.kind == "consistency":
            if f.consistency != u.value and (f.consistency, u.value) not in TRANSITIONS and not allow_incompatible:
                raise SchemaError(f"{u.name}: {f.consistency} can't become {u.value}")
            new.fields[at] = replace(f, consistency=str(u.value)).checked()
        elif u.kind in ("doc", "future_default"):
            new.fields[at] = replace(f, **{u.kind: u.value})
        else:
            raise SchemaError(f"{u.kind} of {u.name} can't be updated")
    new.id += 1
    return new
