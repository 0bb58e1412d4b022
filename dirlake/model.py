"""The columns of directory entries."""

VALUE = "struct<value: string, origin: string, raw: string>"
ATTRS = f"array<struct<name: string, values: array<{VALUE}>>>"
CONTROLS = "array<struct<control_type: string, criticality: boolean, value: string, value_origin: string, raw_value: string>>"
OPS = f"array<struct<op: string, attr: string, values: array<{VALUE}>>>"

#: What a value was written as.
ORIGINS = ("plain", "base64", "url", "file")
