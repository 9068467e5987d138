"""Operations for large training-text corpora. Nothing else in gridloom imports this."""
