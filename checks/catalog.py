from checks import inputs  # noqa: F401 - derived inputs come first
from checks import detection, masking, reports, scalars, tables, texts  # noqa: F401, E402
