"""Column functions: tokenisers, path and identifier parts, text normalisation, cosine."""
