"""Named analytics: each is a plain function (Tables, Params) -> DataFrame."""
