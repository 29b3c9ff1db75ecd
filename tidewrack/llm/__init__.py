"""Operations for training-data pipelines; nothing else in tidewrack imports this subpackage."""
