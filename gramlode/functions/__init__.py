"""Column builders: text cleaning, inflection, markup and sampling."""
