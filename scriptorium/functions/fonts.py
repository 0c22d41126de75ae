"""Font choice for page headers and footers."""

from pyspark.sql import functions as F

# Page font per name fragment, first hit wins, and the default size.
PAGE_FONTS = [("times", "tiro"), ("courier", "cour")]
DEFAULT_PAGE_FONT = "helv"
DEFAULT_PAGE_FONT_SIZE = 10.0


def given_name(font_name):
    """Null where the request left the name unset, which '' does too."""
    return F.nullif(font_name, F.lit(""))


def given_size(font_size):
    """Null where the request left the size unset, which 0 does too."""
    return F.nullif(font_size, F.lit(0.0))


def page_font(font_name):
    lowered = F.lower(font_name)
    choice = F.lit(DEFAULT_PAGE_FONT)
    for fragment, font in reversed(PAGE_FONTS):
        choice = F.when(lowered.contains(fragment), F.lit(font)).otherwise(choice)
    return choice


def page_font_size(font_size):
    return F.coalesce(given_size(font_size), F.lit(DEFAULT_PAGE_FONT_SIZE))
