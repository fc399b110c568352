"""Files of the binary formats, built from rows."""

from helixlake.sources.encoders import *  # noqa: F403
