from postledger.streaming.landed import sync_landed

__all__ = ["sync_landed"]
